"""Which reader, parser or box source a file gets, and what follows from a failed call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Media types by file extension.
MIME = {
    ".pdf": "application/pdf", ".csv": "text/csv", ".txt": "text/plain", ".html": "text/html", ".md": "text/markdown", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".tiff": "image/tiff", ".bmp": "image/bmp", ".gif": "image/gif",
    ".mp3": "audio/mpeg", ".wav": "audio/x-wav", ".zip": "application/zip", ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
URL_TYPES = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".gif")
# Texts of pages that ask for proof of a human reader.
CHALLENGES = ("just a moment", "checking your browser", "verify you are human", "enable javascript and cookies", "access denied", "attention required", "captcha", "security check", "unusual traffic", "are you a robot")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def mime_type(path: Column) -> Column:
    """Media type by extension; null if it isn't known."""
    return F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])[extension(path)]


def supported(mime: Column) -> Column:
    known = mime.startswith("image/") | mime.startswith("text/") | mime.startswith("audio/") | (mime == "application/pdf") | mime.rlike("wordprocessing|spreadsheet|presentation")
    return F.coalesce(known, F.lit(False))


def supported_url(url: Column) -> Column:
    return F.coalesce(extension(F.try_parse_url(url, F.lit("PATH"))).isin(*URL_TYPES), F.lit(False))


def has_token(raw: Column, token: str) -> Column:
    """A part between slashes that is just ``token``."""
    return F.array_contains(F.transform(F.split(F.lower(raw), "/"), lambda x: F.trim(x)), token)


def route(mime: Column, has_image: Column, has_link: Column, accurate: Column) -> Column:
    """STATIC_PARSE or LLM_PARSE: cheap parsing for what needs no eyes."""
    plain_pdf = (mime == "application/pdf") & ~has_image
    return (
        F.when(mime.startswith("text/") | mime.rlike("spreadsheet|presentation"), "STATIC_PARSE")
        .when(mime.startswith("audio"), "LLM_PARSE")
        .when(accurate & plain_pdf & has_link, "STATIC_PARSE")
        .when(~accurate & plain_pdf, "STATIC_PARSE")
        .otherwise("LLM_PARSE")
    )


def box_source(mime: Column, has_image: Column) -> Column:
    return F.when(mime.startswith("image/"), "ocr").when((mime == "application/pdf") & has_image, "ocr").when(mime == "application/pdf", "layout")


def overrides(ext: Column, parser: Column) -> Column:
    """Input mode: word files for a model go as PDF, sheets and slides are parsed statically whatever was asked."""
    return F.when(ext.isin(".doc", ".docx") & (parser != "STATIC_PARSE"), "as_pdf").when(ext.isin(".xlsx", ".pptx") & (parser == "LLM_PARSE"), "static").otherwise("as_is")


def cheap_first(raw_length: Column, threshold: int = 100) -> Column:
    """OCR text is taken if it is short of the threshold; else the model reads the page."""
    return F.when(raw_length < threshold, "OCR").otherwise("LLM_PARSE")


def provider(model: Column) -> Column:
    """Provider by a model's name: the first rule that fits; null if none does."""
    m = F.lower(model)
    return (
        F.when(m.startswith("gemini"), "gemini").when(m.startswith("gpt"), "openai")
        .when(m.startswith("meta-llama") & (m.contains("turbo") | (model == "meta-llama/Llama-Vision-Free")), "together")
        .when(m.startswith("meta-llama"), "huggingface").when(m.rlike("^(microsoft|google|qwen)"), "openrouter")
        .when(m.startswith("accounts/fireworks"), "fireworks").when(m.startswith("claude"), "anthropic")
        .when(m.startswith("mistral"), "mistral").when(m.startswith("deepseek"), "deepseek")
        .when(m.rlike("^(minimax|m2-)"), "minimax").when(m.contains("docling") | m.startswith("paddlepaddle/paddleocr-vl"), "local")
    )


def service_failure(name: Column, status: Column) -> Column:
    n = F.lower(name)
    named = n.rlike("connection|timeout") | n.isin("urlerror", "ratelimiterror", "internalservererror", "authenticationerror", "permissiondeniederror", "modelunavailableerror")
    return named | F.coalesce(status.isin(401, 403, 408, 429) | (status >= 500), F.lit(False))


def next_step(name: Column, status: Column, invalid: Column, has_fallback: Column, metadata_only: Column, attempt: Column, attempts: int = 2) -> Column:
    """What to do after a failed attempt (from 0): retry, pause_document, use_tex or fallback_page."""
    n = F.lower(name)
    service = service_failure(name, status)
    retryable = invalid | F.coalesce(status.isin(429, 408, 500, 502, 503, 504), F.lit(False)) | n.rlike("connection|timeout")
    budget = F.when(service, 2).otherwise(attempts)
    again = (retryable | service) & (attempt + 1 < budget) & ~F.coalesce(status.isin(401, 403), F.lit(False)) & ~(metadata_only & has_fallback)
    return F.when(again, "retry").when(service, "pause_document").when(has_fallback, "use_tex").otherwise("fallback_page")


def challenged(title: Column, text: Column) -> Column:
    seen = F.lower(F.concat(title, F.lit("\n"), F.substring(text, 1, 4000)))
    return F.exists(F.array(*map(F.lit, CHALLENGES)), lambda m: F.contains(seen, m))


def page_ranges(docs: DataFrame, pages: Column, per_split: int = 4) -> DataFrame:
    """A row for each range of pages of a document, with its file name; 1-based, inclusive."""
    out = docs.withColumn("_pages", pages.cast("int")).where("_pages > 0").withColumn("start", F.explode(F.sequence(F.lit(1), F.col("_pages"), F.lit(per_split))))
    out = out.withColumn("end", F.least(F.col("start") + per_split - 1, F.col("_pages")))
    return out.withColumn("name", F.format_string("split_%04d_%d.pdf", "start", "end")).drop("_pages")


def worker_chunks(ranges: DataFrame, id_col: str, workers: int = 4) -> DataFrame:
    """Numbers a document's ranges and the chunk of max(1, floor(n / workers)) that each goes to."""
    each = ranges.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "name"))).alias("r"))
    size = F.greatest(F.lit(1), F.floor(F.size("r") / workers)).cast("int")
    return each.select(id_col, size.alias("size"), F.posexplode("r").alias("split_no", "x")).select(id_col, "split_no", (F.floor(F.col("split_no") / F.col("size"))).cast("int").alias("chunk"))
