"""Secret scans with corpus-wide ownership frequency.

Spans come from regular expressions over whole texts. Every span's value is hashed, and over
the whole corpus each hash is aggregated by distinct repositories and owners. A value that
many owners hold is a widely copied example; one that few hold is owner-specific and looks
live. Values without a keyword, which no single document tells from any other token, are
reported only when their ownership makes them look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshgrain.llm.common import stash

_KEYWORD = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Leftmost matches of `AKIA[A-Z0-9]+` with 16 characters or more, and of `[0-9a-f]+` with 32 or more, are these:
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
#: Tokens that the method judges by their owners: a token of a known provider's shape.
TOKEN = r"(?:ghp_|gho_|sk-|sk_live_|xox[abp]-|glpat-|AIza|eyJ)[A-Za-z0-9_-]{16,}"
KINDS = ("assign", "access", "hex", "token")
#: A value of this many owners or more is a widely copied example.
EXAMPLE_OWNERS = 3

#: A value's owners meet its spans in this many groups, as one value may be in a third of all rows.
SALTS = 16


def _matches(text: Column, kind: int, pattern: str, least: int = 0) -> Column:
    """Matches in order: (kind_no, gap, size, sha); gap is what lies between a match and the one before it, sha null for what fails `least`."""
    pairs = F.filter(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap")), lambda p: p["m"].isNotNull())

    def of(p: Column) -> Column:
        value = F.regexp_extract(p["m"], pattern, 2) if kind == 0 else p["m"]
        return F.struct(F.lit(kind).alias("kind_no"), F.length(p["gap"]).cast("long").alias("gap"), F.length(p["m"]).cast("long").alias("size"), F.when(F.length(value) >= least, F.sha2(value, 256)).alias("sha"))

    # most texts hold none: one scan tells
    return F.when(text.rlike(pattern), F.transform(pairs, of)).otherwise(F.array().cast("array<struct<kind_no:int,gap:long,size:long,sha:string>>"))


def unused(columns: list[str], name: str) -> str:
    """name, made longer until no column has it."""
    while name in columns:
        name += "_"
    return name


def secret_spans(docs: DataFrame, repository: str = "doc_id", owner: str = "source", example_owners: int = EXAMPLE_OWNERS, out: str = "spans") -> DataFrame:
    """One row for each row of docs, all its columns kept, with `out` (spans) added or replaced: an array, by start
    and then kind, of (kind, start, end, value_sha256, n_repositories, n_owners, status).

    Places are code points, end exclusive. status is `example` for values that example_owners
    owners or more hold, else `live`. Spans of kind token appear only when live and outside
    every other span. A null text is empty; a null owner or repository counts as one of its
    own. Very long texts are scanned whole, in time that grows with their length and matches; repeated rows
    have the same spans, and an empty table gives an empty result. The table is written once with its matches and read again for the counts.
    """
    found = _judged(docs, repository, owner, example_owners, out)
    names = ("start", "kind_no", "kind", "end", "value_sha256", "n_repositories", "n_owners", "status")
    return found.select("_kept.*", F.transform("_spans", lambda s: F.struct(*(s[n].alias(n) for n in names))).alias(out))


def _judged(docs: DataFrame, repository: str, owner: str, example_owners: int, out: str) -> DataFrame:
    """_kept (the columns of docs but `out`) and _spans, each with `reach`: how far the spans before it go."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.concat(_matches(text, 0, ASSIGN, least=8), _matches(text, 1, ACCESS), _matches(text, 2, HEX), _matches(text, 3, TOKEN))
    keep = [c for c in docs.columns if c != out]
    scanned = stash(docs.select(F.col(repository).cast("string").alias("_repository"), F.col(owner).cast("string").alias("_owner"), F.monotonically_increasing_id().alias("_row"), found.alias("_found"), F.struct(*[f"`{c}`" for c in keep]).alias("_kept")))
    each = scanned.where("size(_found) > 0").select("_row", "_repository", "_owner", F.posexplode("_found").alias("at", "f")).select("_row", "_repository", "_owner", "at", "f.*")
    named = each.where("sha is not null")
    held = lambda c: named.select("sha", F.struct(c).alias("x")).distinct().groupBy("sha").agg(F.count("*").alias("n"))
    owners = held("_repository").withColumnRenamed("n", "n_repositories").join(held("_owner").withColumnRenamed("n", "n_owners"), "sha")
    owners = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # places are running sums; all windows share one exchange by row
    upto = Window.partitionBy("_row", "kind_no").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.repartition("_row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size")).where("sha is not null")
    order = Window.partitionBy("_row").orderBy("start", "kind_no")
    base = F.col("kind_no") < 3
    reached = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    follows = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    placed = placed.withColumn("clear", base | (F.coalesce(reached <= F.col("start"), F.lit(True)) & F.coalesce(follows >= F.col("end"), F.lit(True)))).where("clear")
    status = F.when(F.col("n_owners") >= example_owners, "example").otherwise("live")
    judged = placed.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(owners, ["sha", "salt"]).withColumn("status", status).where("kind_no < 3 or status = 'live'")
    judged = judged.repartition("_row").withColumn("reach", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.struct("start", "kind_no", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind_no") + 1).alias("kind"), "end", F.col("sha").alias("value_sha256"), "n_repositories", "n_owners", "status", "reach")
    spans = judged.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    none = F.array().cast(spans.schema["_spans"].dataType)
    return scanned.join(spans, "_row", "left").select("_kept", F.coalesce("_spans", none).alias("_spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every secret span in text replaced by a mark, n_chars brought up to date where it is there; other columns as they are.

    Spans that overlap become one mark. Null and empty texts stay as they are, repeated rows become
    the same, very long texts are redacted whole; an empty table gives an empty result.
    """
    found = _judged(docs, "doc_id", "source", EXAMPLE_OWNERS, unused(docs.columns, "_secrets"))
    text = F.coalesce(F.col("_kept.text").cast("string"), F.lit(""))
    piece = lambda s: F.concat(F.when(s["start"] > s["reach"], text.substr(s["reach"].cast("int") + 1, (s["start"] - s["reach"]).cast("int"))).otherwise(""), F.when(s["start"] >= s["reach"], F.lit(mark)).otherwise(""))
    last = F.array_max(F.transform("_spans", lambda s: s["end"]))
    some = F.size("_spans") > 0
    new = F.when(some, F.concat(F.array_join(F.transform("_spans", piece), ""), text.substr(last.cast("int") + 1, F.length(text)))).otherwise(F.col("_kept.text"))
    now = {"text": new, "n_chars": F.when(some, F.length(new).cast("long")).otherwise(F.col("_kept.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[now[c].alias(c) if c in now else F.col(f"_kept.`{c}`") for c in docs.columns])


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts and digests of the spans of each row, and how many look live."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < 3)
    return scanned.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["status"] == "live")).cast("long").alias("n_live"))
