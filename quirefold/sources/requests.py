"""Requests: addresses of stored objects, page lists and their checks, form fields, payloads of model servers."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .objects import public_url, url_verdict

# Pages and listed objects at most, bytes and pixels of a picture at most.
MOST_PAGES, MOST_BYTES, MOST_PIXELS = 200, 25 << 20, 50_000_000


@dataclass(frozen=True)
class Store:
    """Where objects are: the public address they are read by, and their bucket."""

    base: str
    bucket: str

    def __post_init__(self) -> None:
        at = urlsplit(self.base)
        if at.scheme not in ("http", "https") or not at.hostname or at.username or at.password or at.query or at.fragment or not self.bucket:
            raise ValueError("a store needs an http address without credentials, query or fragment, and a bucket")

    @property
    def host(self) -> str:
        return (urlsplit(self.base).hostname or "").lower()

    @property
    def port(self) -> int:
        at = urlsplit(self.base)
        return at.port or (443 if at.scheme == "https" else 80)

    @property
    def path(self) -> str:
        return unquote(urlsplit(self.base).path).strip("/")


def normal_key(key: Column) -> Column:
    """A key without leading slashes, or null if it is empty or a segment is empty, . or .. ."""
    clean = F.regexp_replace(key, "^/+", "")
    return F.when((clean != "") & ~F.exists(F.split(clean, "/"), lambda s: s.isin("", ".", "..")), clean)


def object_reference(url: Column, store: Store) -> Column:
    """struct(verdict, key, source_url): ok with the key and the address without its query, or the rule that is broken."""
    path = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    plain = F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^/+|/+$", "")
    inner = F.when(F.lit(store.path == ""), plain).when(plain.startswith(store.path + "/"), F.substr(plain, F.lit(len(store.path) + 2)))
    bucket, key = F.regexp_extract(inner, "^([^/]+)/.", 1), normal_key(F.regexp_extract(inner, "^[^/]+/(.+)$", 1))
    first = url_verdict(url, store.host, store.port)
    verdict = (
        F.when(first.isin("scheme", "credentials", "fragment", "authority"), first)
        .when(inner.isNull(), "base path")
        .when(bucket == "", "no key")
        .when(bucket != store.bucket, "bucket")
        .when(key.isNull(), "segment")
        .otherwise("ok")
    )
    ok = verdict == "ok"
    return F.struct(verdict.alias("verdict"), F.when(ok, key).alias("key"), F.when(ok, public_url(f"{store.base.rstrip('/')}/{store.bucket}", key)).alias("source_url"))


def object_field(raw: Column) -> Column:
    """struct(verdict, value): a form field that holds a JSON object; null and empty ones hold {}."""
    text = F.when(F.coalesce(raw, F.lit("")) == "", "{}").otherwise(raw)
    value = F.try_parse_json(text)
    return F.struct(F.when(value.isNull(), "invalid").when(~F.schema_of_variant(value).startswith("OBJECT"), "not an object").otherwise("ok").alias("verdict"), F.when(F.schema_of_variant(value).startswith("OBJECT"), F.to_json(value)).alias("value"))


DESCRIPTORS = "array<struct<page_id:string,page_number:int,filename:string>>"


def page_descriptors(forms: DataFrame, doc: str, raw: str, names: str) -> DataFrame:
    """Images and their descriptors by position: (doc, page_number, page_id, filename, verdict).

    raw: a JSON array, one entry an image, or empty; names: array<string> of uploaded file names. Without descriptors pages are
    numbered from 1. A document whose array is none or of another length has a row per image with the verdict.
    """
    given = F.coalesce(F.col(raw), F.lit("")) != ""
    parsed = F.from_json(F.col(raw), DESCRIPTORS)
    verdict = F.when(given & (parsed.isNull() | ~F.ltrim(F.col(raw)).startswith("[")), "invalid").when(given & (F.size(parsed) != F.size(names)), "length").otherwise("ok")
    rows = forms.select(doc, F.posexplode(names).alias("i", "name"), verdict.alias("verdict"), F.when(given, parsed).alias("d"))
    d = F.when(F.col("verdict") == "ok", F.get("d", F.col("i")))
    number = F.coalesce(d["page_number"], F.col("i") + 1)
    name = F.coalesce(d["filename"], F.when(F.col("name") != "", F.col("name")), F.format_string("page_%d.image", F.col("i") + 1))
    return rows.select(doc, number.alias("page_number"), F.coalesce(d["page_id"], F.concat(F.col(doc).cast("string"), F.lit(":p"), number.cast("string"))).alias("page_id"), name.alias("filename"), "verdict")


def request_verdicts(pages: DataFrame, doc: str, most: int = MOST_PAGES) -> DataFrame:
    """One row per document: (doc, verdict, n_pages): ok, or the first rule its request breaks.

    pages: (doc, position from 0, page_number, page_id, key, native_number). Null numbers and ids have defaults.
    """
    name = F.trim(F.col(doc).cast("string"))
    number = F.coalesce("page_number", F.col("position") + 1)
    rows = pages.withColumn("_n", number).withColumn("_id", F.coalesce("page_id", F.concat(name, F.lit(":p"), number.cast("string"))))
    inside = F.coalesce(F.col("key").startswith(F.concat(F.lit("documents/"), name, F.lit("/images/"))), F.lit(False))
    twice = lambda c: F.count(F.lit(1)).over(Window.partitionBy(doc, c)) > 1
    rows = rows.select(doc, twice("_n").alias("n2"), twice("_id").alias("i2"), inside.alias("in"), F.coalesce(F.col("native_number") != F.col("_n"), F.lit(False)).alias("other"))
    got = rows.groupBy(doc).agg(F.count(F.lit(1)).alias("n_pages"), F.max("n2").alias("n2"), F.max("i2").alias("i2"), F.min("in").alias("in"), F.max("other").alias("other"))
    unsafe = (name == "") | name.isin(".", "..") | name.contains("/") | name.contains("\\")
    verdict = F.when(unsafe, "document").when(F.col("other"), "native page").when(F.col("n2"), "page_number").when(F.col("i2"), "page_id").when(F.col("n_pages") > most, "pages").when(~F.col("in"), "prefix").otherwise("ok")
    return got.select(doc, verdict.alias("verdict"), "n_pages")


def fetched_pages(requests: DataFrame, spark: SparkSession, folder: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """requests (key, ...) with content and error: objects not found, empty (Spark lists none) or too large have an error only."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    marked = found.select(F.regexp_replace("path", "^.*?" + folder.rstrip("/").split(":")[-1].lstrip("/") + "/", "").alias("key"), "length", F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))
    error = F.when(F.col("length").isNull(), "not found or empty").when(F.col("length") > most_bytes, "too large")
    return requests.join(marked, "key", "left").withColumn("error", error).drop("length")


def unwrapped(payload: Column) -> Column:
    """A model's result out of the json and res fields it may be nested in, as JSON text; null for no JSON."""
    v = F.try_parse_json(payload)
    inner = F.coalesce(F.try_variant_get(v, "$.json", "variant"), v)
    return F.to_json(F.coalesce(F.try_variant_get(inner, "$.res", "variant"), inner))


def streamed_answers(chunks: DataFrame, request: list[str], order: str, line: str) -> DataFrame:
    """One row per request: (request..., content, verdict) of the JSON lines a model server sent.

    Contents are joined in order. ok needs a last line that is done for another reason than length.
    """
    v = F.try_parse_json(F.col(line))
    part = F.struct(F.col(order).alias("o"), F.try_variant_get(v, "$.message.content", "string").alias("c"), F.try_variant_get(v, "$.error", "string").alias("e"), F.coalesce(F.try_variant_get(v, "$.done", "boolean"), F.lit(False)).alias("d"), F.try_variant_get(v, "$.done_reason", "string").alias("r"), v.isNull().alias("bad"))
    got = chunks.where(F.trim(line) != "").groupBy(*request).agg(F.array_sort(F.collect_list(part)).alias("l"))
    last = F.element_at("l", -1)
    verdict = F.when(F.exists("l", lambda x: x["bad"]), "invalid").when(F.exists("l", lambda x: x["e"].isNotNull()), "error").when(~last["d"], "unfinished").when(F.coalesce(last["r"] == "length", F.lit(False)), "length").otherwise("ok")
    return got.select(*request, F.array_join(F.transform("l", lambda x: x["c"]), "").alias("content"), verdict.alias("verdict"))
