"""Text normalisation as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: results depend on them

LEGAL_SUFFIXES = ("eireli", "ltda", "me", "epp")
GENERIC_PAGE_NAMES = ("contato", "contact", "fale conosco", "home", "inicio", "pagina inicial", "sobre", "sobre nos")
STATES = {
    "acre": "ac", "alagoas": "al", "amapa": "ap", "amazonas": "am", "bahia": "ba", "ceara": "ce",
    "distrito federal": "df", "espirito santo": "es", "goias": "go", "maranhao": "ma", "mato grosso": "mt",
    "mato grosso do sul": "ms", "minas gerais": "mg", "para": "pa", "paraiba": "pb", "parana": "pr",
    "pernambuco": "pe", "piaui": "pi", "rio de janeiro": "rj", "rio grande do norte": "rn",
    "rio grande do sul": "rs", "rondonia": "ro", "roraima": "rr", "santa catarina": "sc", "sao paulo": "sp",
    "sergipe": "se", "tocantins": "to",
}
STOP_WORDS = ("a", "as", "com", "da", "das", "de", "do", "dos", "e", "em", "empresa", "empresas", "na", "nas", "no", "nos", "o", "os", "para", "servico", "servicos")
#: Beginnings of words and the concept that each stands for.
CONCEPT_STEMS = (
    ("odontolog", "odontologia"), ("dentist", "odontologia"), ("dentari", "odontologia"), ("restaur", "restaurante"), ("gastronom", "restaurante"),
    ("contab", "contabilidade"), ("contador", "contabilidade"), ("account", "contabilidade"), ("mecanic", "mecanica"), ("automotiv", "mecanica"),
)
CONCEPTS = ("contabilidade", "mecanica", "odontologia", "restaurante")
INSTAGRAM_RESERVED = ("accounts", "direct", "explore", "p", "reel", "reels", "stories")
#: Patterns of the contact sanitiser, in the order in which they apply. Java syntax; (?iuU) makes case and classes Unicode's.
SANITISERS = (
    r"""(?iuU)(?:^|[.,;|])\s*(?:acesse|site|veja|visite)\s+(?:https?://|www\.)[^\s<>"']+""",
    r"""(?iuU)\b(?:https?://|www\.)[^\s<>"']+""",
    r"""(?iuU)\b[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+\.[a-z]{2,}\b""",
    r"""(?iuU)(?:^|[.,;|])\s*(?:whats(?:app)?|zap|telefone|tel\.?|phone|celular|e-?mail|contato|cnpj)\b[^.;|]*""",
    r"""(?iuU)(?:^|[.,;|])\s*(?:endere[cç]o|logradouro|rua|r\.|avenida|av\.?|alameda|travessa|rodovia|estrada|pra[cç]a)\b[^.;|]*""",
    r"""(?iuU)(?:^|[.,;|])\s*(?:bairro|cep|localizad[oa]s?|situad[oa]s?|ficamos?|fica)\b[^.;|]*""",
    r"""(?U)(?<!\w)\+?\d[\d\s()./\-]{1,}\d(?!\w)""",
)
NEGATIVE_MENTION = r"(?iuU)(?:n[aã]o\s+(?:temos|possui|dispon[ií]vel).{0,20}whats\s*app|whats\s*app\s+(?:n[aã]o\s+dispon[ií]vel|indispon[ií]vel))"
LABELLED_NUMBER = r"(?iuU)(?:whats(?:app)?|zap)[^+0-9]{0,30}(\+?[0-9][0-9\s().-]{8,20}[0-9])"
SAFE_SOURCE_KEYS = ("category", "category_text", "schema_types", "type")
SAFE_TAG_KEYS = ("amenity", "craft", "healthcare", "healthcare:speciality", "office", "shop")
MAX_EVIDENCE_CHARS, MAX_CELL_CHARS = 360, 32_767


def _bare(ch: str) -> str:
    """The compatibility decomposition of a character without combining marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))


#: Code points below this one have a table of their own.
NEAR = 0x250


@cache
def _forms(folded: bool) -> tuple[str, str, dict[str, str]]:
    """By rule, for every code point but Hangul syllables: those that become one character (or none), what they become, and those that become several."""
    one, none, several = {}, [], {}
    for code in (*range(0x41, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)):
        ch = chr(code)
        to = _bare(ch).casefold() if folded else _bare(ch)
        if len(to) > 1:
            several[ch] = to
        elif not to:
            none.append(ch)
        elif to != ch:
            one[ch] = to
    return "".join([*one, *none]), "".join(one.values()), several


def _hangul(x: Column) -> Column:
    """The letters of a Hangul syllable: syllables stand in order of first letter, vowel, last letter."""
    n = F.position(x, F.lit("".join(map(chr, range(0xAC00, 0xD7A4))))) - 1
    letters = [F.lit("".join(map(chr, range(first, first + count)))) for first, count in ((0x1100, 19), (0x1161, 21), (0x11A8, 27))]
    last = (n % 28).cast("int")
    return F.concat(
        F.substring(letters[0], F.floor(n / 588).cast("int") + 1, F.lit(1)), F.substring(letters[1], F.floor(n % 588 / 28).cast("int") + 1, F.lit(1)),
        F.when(last > 0, F.substring(letters[2], last, F.lit(1))).otherwise(F.lit("")),
    )


def _ranges(chars: Iterable[str]) -> str:
    """A regular expression's class of these characters."""
    out: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]"


def _mapped(c: Column, folded: bool) -> Column:
    source, target, several = _forms(folded)
    keys, values = F.lit("".join(several)), F.split(F.lit("|".join(several.values())), "[|]")
    letter = lambda x: F.when(x.between("\uac00", "\ud7a3"), _hangul(x)).when(F.position(x, keys) > 0, F.get(values, F.position(x, keys) - 1)).otherwise(x)
    spread = F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), letter), "")
    rare = F.when(c.rlike(_ranges([*several, *map(chr, range(0xAC00, 0xD7A4))])), spread).otherwise(c)
    full = F.translate(rare, source, target)
    # of the letters of European languages sharp s alone becomes several; a small table does for the rest
    near = {k: v for k, v in zip(source, target.ljust(len(source), "\0"), strict=True) if ord(k) < NEAR and v != "\0"}
    sharp = F.replace(c, F.lit("ß"), F.lit("ss")) if folded else c
    quick = F.translate(sharp, "".join(near), "".join(near.values()))
    wide = {*filter(lambda x: ord(x) < NEAR and x != "ß", several)}
    other = ~c.rlike(rf"^(?:[\x00-\x7f]++|{_ranges(x for x in map(chr, range(0x80, NEAR)) if x not in wide)}++)*+\z")
    # most texts are ASCII alone, of as many bytes as characters
    plain = F.lower(c) if folded else c
    return F.when(F.octet_length(c) == F.char_length(c), plain).when(other, full).otherwise(quick)


def strip_accents(c: Column) -> Column:
    """The compatibility decomposition of a text (NFKD) without combining marks."""
    return _mapped(c, False)


#: White space as Unicode defines it, and the four separators that count as such. Spelt out: by class a character takes longer.
SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def normalize_text(c: Column) -> Column:
    """Without accents, case-folded, white space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(_mapped(c, True), SPACES, " "))


def fingerprint(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def company_name(c: Column) -> Column:
    """Words of ASCII letters and digits, without legal forms at the end; may be empty."""
    words = F.trim(F.regexp_replace(normalize_text(c), "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), words), f"( ({'|'.join(LEGAL_SUFFIXES)}))+$", ""))


def identity_text(c: Column) -> Column:
    """Letters and digits of any script as words; null if there are none."""
    return F.nullif(F.trim(F.regexp_replace(normalize_text(c), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def state_code(c: Column) -> Column:
    text = identity_text(c)
    names = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, text), text)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def tax_id(c: Column) -> Column:
    """The 14 digits of a tax id as observed; null for any other number of digits."""
    return F.when(F.length(digits(c)) == 14, digits(c))


def tax_id_checked(c: Column) -> Column:
    """A tax id whose two check digits hold and whose digits are not all the same."""
    d = tax_id(c)

    def check(weights: Sequence[int]) -> Column:
        total = sum((F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
        rest = total % 11
        return F.when(rest < 2, F.lit(0)).otherwise(F.lit(11) - rest)

    first, second = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
    fits = (F.substring(d, 13, 1).cast("int") == check(first)) & (F.substring(d, 14, 1).cast("int") == check(second))
    return F.when(fits & ~d.rlike(r"^(.)\1*$"), d)


def category_tokens(c: Column) -> Column:
    """The distinct words of a category that carry meaning, each as its concept or without a plural s."""
    words = F.regexp_extract_all(normalize_text(c), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) >= 3))

    def canonical(w: Column) -> Column:
        out = F.when((F.length(w) > 4) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
        for stem, concept in reversed(CONCEPT_STEMS):
            out = F.when(w.startswith(stem), F.lit(concept)).otherwise(out)
        return out

    return F.array_distinct(F.transform(kept, canonical))


def known_concepts(c: Column) -> Column:
    return F.array_intersect(category_tokens(c), F.array(*[F.lit(x) for x in CONCEPTS]))


def coverage(expected: Column, observed: Column) -> Column:
    """Share of the expected tokens that are observed; 0 if none are expected."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, observed)) / F.size(expected)).otherwise(F.lit(0.0))


def number_variant(c: Column) -> Column:
    """The other grammatical number of a Portuguese term, by its last word."""
    term = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    last = F.element_at(F.split(term, " "), -1)
    plain = normalize_text(last)
    cut = lambda n: F.substring(term, F.lit(1), F.length(term) - n)
    return (
        F.when(plain.endswith("oes") & (F.length(last) > 3), F.concat(cut(3), F.lit("ão")))
        .when(plain.endswith("ais") & (F.length(last) > 3), F.concat(cut(3), F.lit("al")))
        .when(plain.endswith("is") & (F.length(last) > 2), F.concat(cut(2), F.lit("il")))
        .when(plain.endswith("s") & (F.length(last) > 2), cut(1))
        .otherwise(F.concat(term, F.lit("s")))
    )


_CRITERIA = r"(?iuU)^(.+?)\s+(?:em|no|na|nos|nas)\s+([^,;]+(?:\s*[,/-]\s*[^,;]+)?)$"


def split_query(c: Column) -> Column:
    """struct(category, location) of "<category> em <location>"; nulls if the query has another form."""
    clean = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    part = lambda i: F.nullif(F.trim(F.regexp_extract(clean, _CRITERIA, i)), F.lit(""))
    return F.struct(part(1).alias("category"), part(2).alias("location"))


def sanitize(c: Column, max_chars: int = MAX_EVIDENCE_CHARS) -> Column:
    """Text without addresses of any kind, contact clauses, numbers and digits; null if nothing is left."""
    out = c
    for pattern in SANITISERS:
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, r"(?U)\d", " ")
    out = F.btrim(F.regexp_replace(out, r"(?U)\s+", " "), F.lit(" ,;|.-"))
    return F.nullif(F.rtrim(F.substring(out, 1, max_chars)), F.lit(""))


def remove_locations(c: Column, *locations: Column) -> Column:
    """Text without the given places, whatever their case; places of under two characters stay."""
    out = c
    for place in locations:
        clean = place
        for pattern in (SANITISERS[1], SANITISERS[2], SANITISERS[6], r"(?U)\d"):
            clean = F.regexp_replace(clean, pattern, " ")
        clean = F.btrim(F.regexp_replace(clean, r"(?U)\s+", " "), F.lit(" ,;|.-"))
        literal = F.regexp_replace(clean, r"([^\p{L}\p{N} ])", r"\\$1")
        out = F.when(F.length(clean) >= 2, F.regexp_replace(out, F.concat(F.lit("(?iu)"), literal), F.lit(" "))).otherwise(out)
    return F.nullif(F.btrim(F.regexp_replace(out, r"(?U)\s+", " "), F.lit(" ,;|.-")), F.lit(""))


def safe_entries(entries: Column) -> Column:
    """Texts of a source that may reach a classifier: of (key, value) entries of its data and tags, those of the allowed keys."""
    plain = lambda e: F.replace(normalize_text(e["key"]), F.lit(" "), F.lit("_")).isin(*SAFE_SOURCE_KEYS)
    told = F.transform(entries, lambda e: F.when(plain(e), e["value"]).when(e["key"].isin(*SAFE_TAG_KEYS), F.concat_ws(": ", e["key"], e["value"])))
    return F.filter(told, lambda x: x.isNotNull())


def shares_long_token(left: Column, right: Column) -> Column:
    """Whether two texts have a word of four or more characters in common."""
    words = lambda c: F.filter(F.split(normalize_text(c), " "), lambda w: F.length(w) >= 4)
    return F.coalesce(F.arrays_overlap(words(left), words(right)), F.lit(False))


def is_whatsapp_label(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(normalize_text(c), "[^a-z0-9]+", " ").rlike(r"\bwhats\s*app\b"), F.lit(False))


def is_negative_mention(c: Column) -> Column:
    return F.coalesce(c.rlike(NEGATIVE_MENTION), F.lit(False))


def labelled_whatsapp(c: Column) -> Column:
    """The number that a text labels as WhatsApp, as written."""
    return F.nullif(F.regexp_extract(c, LABELLED_NUMBER, 1), F.lit(""))


def excerpt(c: Column, limit: int = 500) -> Column:
    out = F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" ,;|"))
    return F.nullif(F.substring(out, 1, limit), F.lit(""))


def context(text: Column, start: Column, end: Column, reach: int = 100) -> Column:
    """What stands around the characters from start (0-based) to end."""
    first = F.greatest(F.lit(0), start - reach)
    return F.substring(text, (first + 1).cast("int"), (end + reach - first).cast("int"))


def joined_reasons(*reasons: Column) -> Column:
    return F.nullif(F.array_join(F.array_compact(F.array(*reasons)), "; "), F.lit(""))


def safe_cell(c: Column) -> Column:
    """A spreadsheet cell's text: no control characters, nothing that reads as a formula, at most MAX_CELL_CHARS."""
    clean = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "\t", " ")
    clean = F.regexp_replace(clean, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    guarded = F.when(clean.rlike(r"(?U)^\s*[=+\-@]"), F.concat(F.lit("'"), clean)).otherwise(clean)
    return F.substring(guarded, 1, MAX_CELL_CHARS)


def instagram_profile(url: Column) -> Column:
    """The canonical URL of the profile that an Instagram link names; links to posts and other pages give null."""
    handle = F.regexp_extract(url, r"(?i)^(?:https?:)?//(?:www\.)?instagram\.com/+@*([A-Za-z0-9._]{1,30})/*(?:[?#].*)?$", 1)
    return F.when((handle != "") & ~F.lower(handle).isin(*INSTAGRAM_RESERVED), F.concat(F.lit("https://www.instagram.com/"), handle, F.lit("/")))


def display_phone(c: Column) -> Column:
    """A canonical number as people write it; anything else unchanged."""
    n = F.when(c.rlike("^55[0-9]{10,11}$"), F.substring(c, F.lit(3), F.length(c)))
    mid = F.length(n) - 6
    return F.coalesce(F.concat(F.lit("+55 ("), F.substring(n, 1, 2), F.lit(") "), F.substring(n, F.lit(3), mid), F.lit("-"), F.substring(n, -4, 4)), c)


def display_confidence(c: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround(c))).cast("int")


def display_location(city: Column, state: Column) -> Column:
    return F.nullif(F.concat_ws(" / ", F.nullif(F.trim(city), F.lit("")), F.nullif(F.trim(state), F.lit(""))), F.lit(""))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
