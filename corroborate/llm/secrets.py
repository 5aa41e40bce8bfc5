"""Secret scan (operator 7) with corpus-wide ownership frequency, in DataFrame functions alone.

Patterns find candidates; how many distinct owners and repositories hold a candidate's
value tells a widely copied example from an owner's own credential, and the entropy of its
characters tells what looks like a credential from what does not. Strings of high entropy
that no pattern names are reported if they are not copied.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.common import body, checkpointed, hinted, table

#: Fixed values of the base search, in the order of kinds: pattern, group with the value, least length of that group.
#: Runs of access keys and of hex digits are maximal, so a pattern with the least length finds just what would not fail.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: What the method adds: runs of 20 or more characters with letters and digits, of this many bits a character, outside of base spans.
EXTRA, EXTRA_BITS = ("entropy", r"[A-Za-z0-9+/_=-]{20,}"), 3.5
KINDS = [*BASE, EXTRA[0]]
#: A value of fewer bits a character does not look like a credential.
LIVE_BITS = 3.0
#: A value is a copied example if so many owners hold it (more, as the logarithm of the owners seen), or two owners in so many repositories.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 10

KEYS = ["doc_id", "th", "owner", "repository"]
_MATCH = "array<struct<kind:int,pos:int,gap:int,n:int,fits:boolean,value:string,bits:double>>"


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    parts = F.transform(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), share)
    return -F.aggregate(parts, F.lit(0.0), lambda total, p: total + p * F.log2(p))


def _matches(text: Column, pattern: str, group: int, kind: int, least: int) -> Column:
    """All matches, leftmost and apart from each other: what stands between each and the one before, its length, and of its group the digest and the entropy.

    split() gives the text between matches, regexp_extract_all() the matches, from which the
    group is taken; texts without a match are looked at once.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(whole, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    pairs = F.filter(pairs, lambda p: p["m"].isNotNull())

    def match(p: Column, i: Column) -> Column:
        value = p["m"] if group == 0 else F.regexp_extract(p["m"], pattern, group)
        fits = F.length(value) >= least
        if kind == len(BASE):
            fits = fits & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), p["gap"].alias("gap"), F.length(p["m"]).alias("n"), fits.alias("fits"), F.when(fits, F.sha2(value, 256)).alias("value"), F.when(fits, entropy(value)).alias("bits")
        )

    return F.when(text.rlike(pattern), F.transform(pairs, match)).otherwise(F.array().cast(_MATCH))


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, th (hash of the text), owner, repository and matches of each row."""
    text = F.col("__text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), body().alias("__text"))
    found = [_matches(text, pattern, group, kind, least) for kind, (pattern, group, least) in enumerate(BASE.values())]
    extra = F.when(text.rlike("[0-9]"), _matches(text, EXTRA[1], 0, len(BASE), 20)).otherwise(F.array().cast(_MATCH))
    return rows.select("doc_id", F.xxhash64("__text").alias("th"), "owner", "repository", F.concat(*found, extra).alias("matches"))


def spans(found: DataFrame) -> DataFrame:
    """The columns of KEYS with kind, start, end (code points), value and bits of each span of ``found``; spans of EXTRA that touch a base span are none.

    Running sums over a text's matches give the places, running extremes the overlaps, so the
    work grows with the number of matches. Fully repeated rows have their spans once.
    """
    each = found.filter(F.size("matches") > 0).select(*KEYS, F.explode("matches").alias("m")).select(*KEYS, "m.*").dropDuplicates([*KEYS, "kind", "pos"])
    run = Window.partitionBy(*KEYS, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("n")).over(run)
    placed = each.withColumn("end", end).filter("fits").select(*KEYS, "kind", (F.col("end") - F.col("n")).alias("start"), "end", "value", "bits")
    by_start = Window.partitionBy(*KEYS).orderBy("start")
    is_base = F.col("kind") < len(BASE)
    before = F.max(F.when(is_base, F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(is_base, F.col("start"))).over(by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    touched = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    return placed.withColumn("touched", touched).filter(is_base | ~F.col("touched")).drop("touched")


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repositories, places: how widely each value of ``found`` (value, owner, repository) is held. Every step gathers in the map tasks first."""
    by_repository = found.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("places"))


def copied_values(held: DataFrame, owners: int, least: int = COPIED_OWNERS) -> DataFrame:
    """The values of ``held`` (as ownership) that are copied examples, where ``owners`` were seen in all."""
    many = max(least, math.ceil(math.log2(1 + owners)))
    return held.filter((F.col("owners") >= many) | (F.col("owners") >= 2) & (F.col("repositories") >= COPIED_REPOSITORIES)).select("value")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", copied: int = COPIED_OWNERS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, and the columns named by owner and repository) with its secrets.

    Base spans always stay; entropy spans stay if they have EXTRA_BITS and are no copied
    example. n_copied counts the row's spans of copied values, n_live those of others that
    look like a credential. A null text is empty and has no spans; a null owner is one owner;
    rows may repeat; other columns are not read.
    """
    found = checkpointed(candidates(docs, owner, repository))
    placed = checkpointed(spans(found))
    owners = found.select("owner").distinct().count()
    wide = checkpointed(copied_values(ownership(placed), owners, copied))
    marked = placed.join(hinted(wide.withColumn("copied", F.lit(True)), 100_000), "value", "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    marked = marked.filter((F.col("kind") < len(BASE)) | ~F.col("copied") & (F.col("bits") >= EXTRA_BITS))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    line = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    gathered = marked.groupBy(*KEYS).agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{n}") for k, n in enumerate(BASE)), F.count_if("copied").alias("n_copied"), F.count_if(~F.col("copied") & (F.col("bits") >= LIVE_BITS)).alias("n_live"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", line.alias("line")))).alias("all"),
    )
    rows, own = found.drop("matches").alias("r"), gathered.alias("g")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in KEYS]
    both = rows.join(own, same, "left").select("r.doc_id", *(F.coalesce(f"g.{c}", F.lit(0)).alias(c) for c in (*(f"n_{n}" for n in BASE), "n_live", "n_copied")), F.coalesce("g.all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,line:string>>")).alias("all"))
    listed = lambda a: F.array_join(F.transform(a, lambda s: s["line"]), ",")
    base = F.filter("all", lambda s: s["kind"] < len(BASE))
    return both.select("doc_id", *(f"n_{n}" for n in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), "n_live", "n_copied")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
