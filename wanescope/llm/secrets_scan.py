"""Secret scanning with corpus-wide ownership frequency, with DataFrame functions only.

Every whole text is matched against the base patterns and a generic pattern for long tokens. The hashes of all candidate values are
aggregated over the corpus: in how many distinct repositories and under how many distinct owners each occurs. A value under many owners
is a widely copied example; one under few owners that looks live (long, letters and digits mixed, no placeholder) is reported. Base
spans stay whatever their verdict; the generic pattern adds spans of kind `live` where no base span overlaps.

A repository column holds `owner/name` or a plain name, which then is its own owner; a null repository counts as one of its own name,
the empty string. Nulls: a null text counts as empty; a null doc_id is a row like any other. Rows of equal doc_id and text have the
same spans and come back as often as they came. A value that a third of the rows share is counted by partial aggregation, and its
join partition can be split. Columns other than the id, text and repository ones, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanescope.llm.common import let, written

#: Fixed patterns of the contract: kind, pattern, group of the value, least characters of that group.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: The method's own: runs of at least 20 token characters.
LIVE = ("live", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
KINDS = [*[b[0] for b in BASE], LIVE[0]]
#: Distinct owners from which a value counts as widely copied.
COPIED_OWNERS = 3
BLOCK = 256

SPAN = "struct<start:bigint,kind:int,end:bigint,value:bigint,looks_live:boolean>"


def running_sums(values: Column) -> Column:
    """For each number the sum of those before it. Two levels of blocks keep the work near-linear for very long arrays."""
    append = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    sums = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), append)
    blocks = let(values, lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK)), lambda b: sums(F.slice(v, b + 1, F.lit(BLOCK)))))
    moved = lambda inner: F.zip_with(inner, F.slice(sums(F.transform(inner, lambda x: F.element_at(x, -1))), F.lit(1), F.size(inner)), lambda x, base: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: y + base))
    return F.flatten(let(blocks, moved))


def looks_live(value: Column) -> Column:
    """Letters and digits mixed, at least 10 different characters, and no word that examples use."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= 20) & value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (different >= 10) & ~value.rlike("(?i)example|placeholder|changeme|xxxx|your")


def spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches, in code points: what splitting leaves between them gives their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def placed(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        sizes = F.transform(m, lambda x: F.length(x).cast("long"))
        return let(F.struct(gaps.alias("g"), sizes.alias("s"), values.alias("v")), one)

    def one(x: Column) -> Column:
        before = running_sums(F.zip_with(F.slice(x["g"], F.lit(1), F.size(x["s"])), x["s"], lambda g, s: g + s))
        starts = F.zip_with(before, F.slice(x["g"], F.lit(1), F.size(x["s"])), lambda b, g: b + g)
        ended = F.arrays_zip(starts.alias("a"), x["s"].alias("b"), x["v"].alias("c"))
        kept = F.filter(ended, lambda y: F.length(y["c"]) >= least)
        return F.transform(kept, lambda y: F.struct(y["a"].alias("start"), F.lit(kind).alias("kind"), (y["a"] + y["b"]).alias("end"), F.xxhash64(y["c"]).alias("value"), looks_live(y["c"]).alias("looks_live")))

    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast(f"array<{SPAN}>")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """(id, thash, repo, base, extra) for every row; a narrow table, written."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    repo = F.coalesce(F.col(repo_col), F.lit("")) if repo_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("thash"), repo.alias("repo"), *[spans(text, i, *b[1:]).alias(b[0]) for i, b in enumerate(BASE)], spans(text, len(BASE), *LIVE[1:]).alias("extra"))
    base = F.array_sort(F.concat(*[F.col(b[0]) for b in BASE]))
    free = F.filter("extra", lambda x: x["looks_live"] & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return written(rows.select("id", "thash", "repo", base.alias("base"), "extra").withColumn("extra", free))


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners) over all candidates of the corpus."""
    seen = found.select(F.explode(F.concat("base", "extra")).alias("x"), "repo").select("x.value", "repo").distinct()
    owned = seen.groupBy("value", F.substring_index("repo", "/", 1).alias("owner")).agg(F.count("*").alias("n"))
    return owned.groupBy("value").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, copied_owners: int = COPIED_OWNERS, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """(doc_id, spans) for every row: an array of (start, kind, end, value, looks_live, n_repos, n_owners, verdict) in the order of start and
    kind; kind is a name, verdict `copied`, `live` or `dull`. Base spans are all there; of the generic ones only live ones."""
    found = candidates(docs, id_col, text_col, repo_col)
    each = found.select("id", "thash", F.explode(F.concat("base", "extra")).alias("x")).select("id", "thash", "x.*").join(ownership(found), "value")
    verdict = F.when(F.col("n_owners") >= copied_owners, "copied").when(F.col("looks_live"), "live").otherwise("dull")
    kept = each.withColumn("verdict", verdict).where((F.col("kind") < len(BASE)) | (F.col("verdict") == "live"))
    per_doc = kept.groupBy("id", "thash").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "value", "looks_live", "n_repos", "n_owners", "verdict"))).alias("spans")).withColumnsRenamed({"id": "id2", "thash": "thash2"})
    both = found.select("id", "thash").join(per_doc, F.col("id").eqNullSafe(F.col("id2")) & (F.col("thash") == F.col("thash2")), "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform("spans", lambda x: x.withField("kind_name", F.get(names, x["kind"])))
    return both.select(F.col("id").alias("doc_id"), F.coalesce(named, F.filter(F.array(F.lit(None)), lambda x: F.lit(False)).cast(f"array<struct<start:bigint,kind:int,end:bigint,value:bigint,looks_live:boolean,n_repos:bigint,n_owners:bigint,verdict:string,kind_name:string>>")).alias("spans"))


def digest(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind_name"], x["start"], x["end"])), ",")
