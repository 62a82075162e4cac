"""Sources: object addresses, listings, request JSON, deterministic detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where the mock detectors find each type, as shares of the page, and how surely.
MOCK_BOXES = (
    ("paragraph", 0.08, 0.08, 0.92, 0.25, 0.99),
    ("table", 0.08, 0.35, 0.92, 0.57, 0.98),
    ("figure", 0.12, 0.63, 0.55, 0.85, 0.98),
    ("stamp", 0.62, 0.72, 0.88, 0.90, 0.97),
    ("signature", 0.52, 0.82, 0.76, 0.94, 0.97),
)


def url_verdict(url: Column, host: str, port: int = 443) -> Column:
    """ok, or the first rule an object's address breaks: scheme, credentials, fragment, authority, path."""
    scheme, authority = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1)), F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1)
    name = F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?([^:]*)", 1))
    given = F.regexp_extract(authority, r":([0-9]+)$", 1)
    effective = F.when(given != "", given.try_cast("int")).when(scheme == "https", 443).otherwise(80)
    path = F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*/+([^?#]*)", 1)
    return (
        F.when(~scheme.isin("http", "https"), "scheme")
        .when(authority.contains("@"), "credentials")
        .when(url.contains("#"), "fragment")
        .when((name != host) | (effective != port), "authority")
        .when(F.exists(F.split(path, "/"), lambda s: s.isin("", ".", "..")), "path")
        .otherwise("ok")
    )


def public_url(base: str, key: Column) -> Column:
    """base and the key's segments, percent-encoded."""
    return F.concat(F.lit(base.rstrip("/") + "/"), F.array_join(F.transform(F.split(key, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/"))


def list_objects(spark: SparkSession, folder: str, limit: int = 100) -> tuple[DataFrame, bool]:
    """Metadata of at most `limit` (1 to 500) objects below a folder, and whether there are more."""
    n = max(1, min(500, limit))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length").orderBy("path").limit(n + 1)
    return found.limit(n), found.count() > n


def read_images(spark: SparkSession, folder: str, most_bytes: int = 25 << 20) -> DataFrame:
    """Object bytes within the size limit; larger and empty ones are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(f"length > 0 AND length <= {most_bytes}")


def json_number(props: Column, path: str) -> Column:
    """A number of a JSON text, null where the text or the field is none."""
    return F.try_variant_get(F.try_parse_json(props), path, "double")


def mock_detections(pages: DataFrame) -> DataFrame:
    """pages (.., width, height) with one row per mock box."""
    spec = F.array(*[F.struct(F.lit(t).alias("type"), *[F.lit(v).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), box, strict=True)], F.lit(c).alias("confidence")) for t, *box, c in MOCK_BOXES])
    rows = pages.withColumn("b", F.explode(spec))
    scaled = {f"{c}": F.round(F.col(f"b.{c}") * F.col(s), 3) for c, s in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))}
    return rows.withColumns({"type": F.col("b.type"), **scaled, "confidence": F.col("b.confidence")}).drop("b")
