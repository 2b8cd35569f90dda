"""Normalisation of texts, numbers and URLs against values worked out by hand and against plain Python."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import phones, text, urls


def values(spark, function, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[1] for r in sorted(df.select("i", function(F.col("x"))).collect())]


@pytest.mark.parametrize("spelling", ["+55 (11) 99876-5432", "0055 11 99876 5432", "011998765432", "0 15 11 99876-5432", "(11) 99876-5432", "11998765432 ramal 12", "https://wa.me/5511998765432", "tel:+5511998765432"])
def test_spellings_of_a_number(spark, spelling):
    assert values(spark, phones.normalize_phone, [spelling]) == ["5511998765432"]


def test_numbers_that_are_none(spark):
    wrong = ["", None, "123", "+1 212 555 0100", "00 44 20 7946 0958", "(20) 99876-5432", "11 8876-54321", "(11) 1234-5678", "998765432", "+55 11 99876-54321"]
    assert values(spark, phones.normalize_phone, wrong) == [None] * len(wrong)


def test_kinds_and_defaults(spark):
    assert values(spark, lambda c: phones.parse_phone(c)["kind"], ["11 99876-5432", "(11) 3456-7890"]) == ["mobile", "landline"]
    assert values(spark, lambda c: phones.normalize_phone(c, F.lit("011")), ["99876-5432"]) == ["5511998765432"]


def test_whatsapp_links(spark):
    links = ["https://api.whatsapp.com/send?phone=5511998765432&text=oi", "whatsapp://send?phone=+5511998765432", "https://wa.me/message/ABC", "https://example.com/send?phone=5511998765432", "wa.me/5511998765432?text=a"]
    assert values(spark, phones.whatsapp_link, links) == ["11998765432", "11998765432", None, None, "11998765432"]


def test_numbers_in_a_text(spark):
    assert values(spark, phones.extract_phones, ["Fixo (11) 3456-7890, celular 11 99876-5432; de novo (11) 3456 7890. CEP 01310-100"]) == [["551134567890", "5511998765432"]]
    # digits of other scripts are digits around a number, but no part of one
    assert values(spark, phones.extract_phones, ["٣11 99876-5432", "(11) 99876-5432 e ٣", "11 99876-543٣"]) == [["5511998765432"], ["5511998765432"], []]


def test_urls(spark):
    cases = {
        "Example.com/a/": "https://example.com/a", "HTTP://WWW.Example.com:080/x?b=1#f": "http://www.example.com:80/x?b=1", "ftp://example.com": None, "https://u:p@example.com": None,
        "https://example.com:99999": None, " ": None, "https://my_host.example.com/": "https://my_host.example.com",
    }
    assert values(spark, urls.normalize_url, list(cases)) == list(cases.values())
    assert values(spark, urls.website_identity, ["https://www.example.com:443/a", "http://example.com:8080", "instagram.com/Loja/x/y", "facebook.com/"]) == ["example.com", "example.com:8080", "instagram.com/loja/x", None]
    assert values(spark, urls.public_url, ["http://10.0.0.1/", "http://localhost/", "http://intranet/", "https://a.example.com./x", "http://8.8.8.8/"]) == [None, None, None, "https://a.example.com/x", "http://8.8.8.8/"]
    assert values(spark, urls.export_url, ["https://u:p@Example.com/a?token=1&q=2&API-key=3#z"]) == ["https://example.com/a?q=2"]


def test_names_and_codes(spark):
    assert values(spark, text.company_name, ["Padaria São João LTDA ME", "ME", "Ação & Cia.", "漢字"]) == ["padaria sao joao", "", "acao cia", ""]
    assert values(spark, text.state_code, ["São Paulo", "sp", "Atlantis", None]) == ["sp", "sp", "atlantis", None]
    assert values(spark, text.tax_id_checked, ["04.252.011/0001-10", "11222333000181", "12345678000190", "11111111111111"]) == ["04252011000110", "11222333000181", None, None]
    assert values(spark, text.number_variant, ["padarias", "padaria", "salões", "hospitais", "imóveis"]) == ["padaria", "padarias", "salão", "hospital", "imóveil"]
    assert values(spark, text.instagram_profile, ["https://instagram.com/loja/", "https://instagram.com/p/abc", "https://www.instagram.com/explore"]) == ["https://www.instagram.com/loja/", None, None]


def test_sanitiser_and_cells(spark):
    assert values(spark, text.sanitize, ["Loja boa. Telefone: 11 99876-5432; Rua A, 10 | veja www.x.com; a@b.com fim", "123", None]) == ["Loja boa", None, None]
    assert values(spark, text.safe_cell, ["=1+1", " @x", "ok\tb\x01"]) == ["'=1+1", "' @x", "ok b"]
    assert values(spark, text.display_phone, ["5511998765432", "551134567890", "x"]) == ["+55 (11) 99876-5432", "+55 (11) 3456-7890", "x"]


def plain_form(x):
    bare = "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", bare.casefold()).strip()


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=30))
def test_normal_form_is_that_of_unicode(spark, texts):
    kept = [x for x in texts if not any(0xD800 <= ord(c) < 0xE000 for c in x)]
    if kept:
        assert values(spark, text.normalize_text, kept) == [plain_form(x) for x in kept]


def test_normal_form_of_every_character(spark):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) not in ("Cn", "Co")]
    some = ["a" + "b".join(every[i : i + 40]) + "." for i in range(0, len(every), 40)]
    assert values(spark, text.normalize_text, some) == [plain_form(x) for x in some]
    assert values(spark, text.strip_accents, some) == ["".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)) for x in some]
    assert values(spark, text.normalize_text, ["\ufb01rma \uff46\uff55\uff4c\uff4c", "\u00b5", "\u0149", "\u2163", "\u03a3\u0391\u03a3", "Stra\u00dfe", "\ud55c\uae00", "a\x1cb", None]) == ["firma full", "\u03bc", "\u02bcn", "iv", "\u03c3\u03b1\u03c3", "strasse", plain_form("\ud55c\uae00"), "a b", None]
