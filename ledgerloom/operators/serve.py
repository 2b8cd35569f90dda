"""Serving of results: pages, JSON, export rows, CSV and XLSX sinks."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable
from typing import BinaryIO
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import export_url
from .metrics import TERMINAL

#: Columns of an export, in order (fixed values).
EXPORT_HEADERS = (
    "Posição", "Nome da empresa", "Telefone", "WhatsApp", "Status do WhatsApp", "Evidência do WhatsApp", "URL da evidência do WhatsApp", "Fontes", "URLs das fontes",
    "Endereço", "Cidade", "Estado/Região", "Categoria/Segmento", "CNPJ", "Website", "Instagram", "Confiança dos dados (%)", "Correspondência da categoria",
    "Confiança da qualificação (%)", "Método da qualificação", "Motivo da qualificação", "Data da coleta (UTC)", "ID da empresa", "ID do resultado", "ID da pesquisa",
)
SHEET_ROWS = 1_048_575


def page(results: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of results: by rank, those without one last, then as created."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset 0 or more")
    return results.orderBy(F.asc_nulls_last("rank"), "created_at", "result_id").offset(offset).limit(limit)


def page_json(results: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One row: items (JSON array in order), total, limit and offset."""
    total = results.agg(F.count(F.lit(1)).alias("total"))
    rows = page(results, limit, offset).withColumn("__o", F.struct(F.coalesce("rank", F.lit(2**31 - 1)), "created_at", "result_id"))
    items = rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("__o", F.struct(*results.columns).alias("item")))), lambda x: x["item"])).alias("items"))
    return items.crossJoin(total).select("items", "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"))


def require_terminal(status: str) -> None:
    if status not in TERMINAL:
        raise ValueError("a search can be exported when it has ended")


def evidence_text(e: Column) -> Column:
    origin = F.when(e["official_source"], F.lit("oficial")).otherwise(F.lit("terceiro"))
    return F.concat_ws(" | ", e["evidence_type"], e["source_provider"], origin, e["normalized_value"], F.nullif(e["excerpt"], F.lit("")))


def export_rows(results: DataFrame) -> DataFrame:
    """The export's columns, from results with company columns, sources (array of display_name, provider, source_url) and evidence.

    Labels and pages are distinct and sorted; evidence comes with official sources first. Texts are safe as cells.
    """
    c = F.col
    lines = lambda a: F.nullif(F.array_join(a, "\n"), F.lit(""))
    none = F.array().cast("array<string>")
    labels = F.transform(F.array_sort(F.array_distinct(F.transform("sources", lambda s: F.struct(F.lower(F.concat(s["display_name"], F.lit(" ["), s["provider"], F.lit("]"))).alias("k"), F.concat(s["display_name"], F.lit(" ["), s["provider"], F.lit("]")).alias("v"))))), lambda x: x["v"])
    urls = lambda a: F.array_sort(F.array_distinct(F.array_compact(F.transform(a, lambda s: export_url(s["source_url"])))))
    proof = F.array_sort(
        F.transform(
            F.filter("evidence", lambda e: e["contact_type"] == "whatsapp"),
            lambda e: F.struct((~e["official_source"]).alias("a"), e["evidence_type"].alias("evidence_type"), e["source_provider"].alias("source_provider"), e["source_url"].alias("source_url"), e["normalized_value"].alias("normalized_value"), e["official_source"].alias("official_source"), e["excerpt"].alias("excerpt")),
        )
    )
    yes_no = F.when(c("category_match"), "sim").when(~c("category_match"), "não")
    values = (
        c("rank"), c("name"), c("phone"), c("whatsapp"), c("whatsapp_status"), lines(F.coalesce(F.transform(proof, evidence_text), none)), lines(F.coalesce(urls(proof), none)), lines(F.coalesce(labels, none)),
        lines(F.coalesce(urls(c("sources")), none)), c("address"), c("city"), c("state"), c("category"), c("cnpj"), export_url(c("website")), export_url(c("instagram")), c("confidence"), yes_no,
        c("qualification_confidence"), c("qualification_method"), c("qualification_reason"), T.utc_text(c("collected_at")), c("company_id").cast("string"), c("result_id").cast("string"), c("search_id").cast("string"),
    )
    numeric = {0, 16, 18}
    return results.select(*[(v if i in numeric else T.safe_cell(v.cast("string"))).alias(h) for i, (h, v) in enumerate(zip(EXPORT_HEADERS, values, strict=True))])


def write_csv(rows: DataFrame, path: str) -> None:
    """The distributed sink: one CSV file per partition, with a header."""
    rows.write.option("header", True).option("escape", '"').csv(path)


def write_xlsx(rows: DataFrame, target: str | BinaryIO, sheet_rows: int = SHEET_ROWS) -> None:
    """A workbook of the rows in their order, written to a path or an open file; new sheets when one is full.

    The driver holds one partition at a time and what is being compressed, never the workbook. For result pages and exports that a
    spreadsheet can hold; larger ones go by write_csv().
    """
    headers = rows.columns

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    def line(values: Iterable[object]) -> str:
        return "<row>" + "".join(map(cell, values)) + "</row>"

    sheets = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        it, more = iter(rows.toLocalIterator()), True
        while more:
            sheets += 1
            with z.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as f:
                f.write(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>')
                f.write(line(headers).encode())
                more = False
                for n, row in enumerate(it, 1):
                    f.write(line(row).encode())
                    if n == sheet_rows:
                        more = True
                        break
                f.write(b"</sheetData></worksheet>")
        ids = range(1, sheets + 1)
        main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{main}.worksheet+xml"/>' for i in ids) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="Resultados {i}" sheetId="{i}" r:id="r{i}"/>' for i in ids) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>")


def hydrated(results: DataFrame, companies: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Results with their company's columns, and their sources and evidence as arrays."""
    src = sources.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("display_name", "provider", "source_url"))).alias("sources"))
    ev = evidence.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("contact_type", "evidence_type", "source_provider", "source_url", "normalized_value", "official_source", "excerpt"))).alias("evidence"))
    return results.join(companies, "company_id").join(src, "result_id", "left").join(ev, "result_id", "left")
