"""Near-duplicate lines by an exact set-similarity join, with DataFrame functions only.

A line is the set of its blank-separated words. Its words are ordered by rarity in the corpus (levels of counts over hash buckets of all
words of all documents; the order only has to be the same everywhere for the join to be exact). A line goes if an earlier line, in the
order of doc_id and line number, reaches the threshold with it; whether that earlier line goes too is no matter.

1. Documents get dense numbers in their order, so a line's place is one number, `c`.
2. Lines of equal text (128 bits of hash) are one class; its first line stands for it, the others go.
3. Near copies are settled: classes that share one of their prefix's least word hashes are compared with the earliest of each of HEADS
   parts of them, so a large group of near copies costs at most HEADS comparisons a member, also where many members are too far from the
   earliest one. A settled class needs no other match, but may still be one for later classes.
4. What is open is joined on prefixes. Sets of n words that reach the threshold share one of their rarest `n - ceil(threshold * n) + 1`
   words, or fewer on the side of the smaller set. A word above HEAVY isn't a key by itself: sets whose first shared word it is share
   another one within the prefix and one word more, so the two together are the key. Length, position and parity filters are part of
   the join; what is left is verified on the words themselves, each class against its earliest candidate first.

Lines of fewer than `min_tokens` different words stay as they are; by default that is blank lines only. Nulls: a null text stays null and
has no lines; null doc_ids come last in the order. Rows of equal doc_id and text are one document, and each of its copies comes back the
same. Columns other than doc_id and text pass through, whatever their names; n_lines and n_removed replace any of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanescope.llm.common import BLANKS, let, released, unused, written

#: Jaccard threshold as a fraction, and the fewest different words of a line that is compared.
THRESHOLD, MIN_TOKENS = (4, 5), 1
#: Hash buckets for word counts: a fixed power of two, whatever the corpus. Levels are half powers of two of a bucket's count.
BUCKETS, LEVEL_BITS = 1 << 18, 7
#: Count of a word's bucket above which the word is a key only together with another one.
HEAVY = 4096
#: Words up to which a line's parities are 64 rather than 128.
SHORT = 64
#: Ranges of set sizes that are joined one after another: the disk holds one range's shuffle at a time.
PASSES = 3
#: Least word hashes by which near copies are met first, and the parts of those of one hash, whose earliest ones are met.
LEAST_HASHES, HEADS = 2, 16
#: Lines to fetch (or settled) up to which their places are sent to all tasks; beyond, both sides are shuffled.
BROADCAST_LINES = 500_000


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS.decode()))


def words_of(text: Column, blanks: bytes = BLANKS) -> Column:
    """The words of a text, split at single blanks, which is quicker than at a pattern; the empty ones between blanks are no words."""
    for blank in blanks.replace(b" ", b"").decode():
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.split(text, " ")


def set_of(line: Column) -> Column:
    return F.array_remove(F.array_distinct(words_of(line, BLANKS.replace(b"\n", b""))), "")


def level_of(count: Column) -> Column:
    return F.floor(2 * F.log2(count)).cast("int")


def word_levels(docs: DataFrame, text_col: str = "text") -> Column:
    """The level of each bucket's count, 0 for buckets without words: an array of BUCKETS numbers as a foldable expression, so that the
    plan holds one array where a column would be copied into every row."""
    words = docs.select(F.explode(words_of(F.col(text_col))).alias("w")).where("w <> ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("id")).agg(F.count("*").alias("n"))
    every = docs.sparkSession.range(BUCKETS).join(counts, "id", "left").select("id", F.coalesce(level_of(F.col("n")), F.lit(0)).alias("level"))
    in_order = F.array_sort(F.collect_list(F.struct("id", "level")))  # BUCKETS entries
    return F.split(F.lit(every.agg(F.array_join(F.transform(in_order, lambda x: x["level"].cast("string")), ",")).first()[0]), ",").cast("array<int>")


def keys_of(words: Column, levels: Column) -> Column:
    """The words, each once, as numbers that sort by rarity: the bucket's level, then bits of the word's hash. Words are hashed before
    equal and empty ones go, and no number is null, so that arrays of primitive numbers are sorted and not strings or objects."""
    rest = 63 - LEVEL_BITS
    level = lambda h: F.coalesce(F.get(levels, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0)).cast("long")
    key = lambda h: F.shiftleft(level(h), rest).bitwiseOR(F.shiftrightunsigned(h, 64 - rest))
    hashes = F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(F.array_remove(hashes, F.xxhash64(F.lit(""))), key))


def parities_of(keys: Column) -> tuple[Column, Column]:
    """Parities of how many words fall on each of 64 bits; for lines of more than SHORT words also of those on the upper half of 128."""
    zero = F.lit(0).cast("long")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))
    parity = lambda of: F.aggregate(of, zero, lambda a, k: a.bitwiseXOR(bit(k)))
    second = F.when(F.size(keys) > SHORT, parity(F.filter(keys, lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(1)) == 1))).otherwise(zero)
    return parity(keys), second  # the first of 128 is the exclusive-or of the two; what is compared needs no more


def prefix_length(n: Column, num: int, den: int) -> Column:
    """n - ceil(num / den * n) + 1."""
    return (n - F.floor((num * n + den - 1) / den) + 1).cast("int")


class Numbered:
    """A table of documents with dense numbers in the order of id (nulls last) and text; rows of equal id and text share theirs.

    rows: docs' columns and `number`; width: more than any document's lines (its bytes bound them); repeated: whether a number occurs twice."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.text = text_col
        self.number = unused(docs, "number")
        marks = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t1"), F.octet_length(text_col).alias("t2")]
        unique = docs.select(*marks).groupBy("id", "t1", "t2").agg(F.count("*").alias("rows"))
        order = [F.col("id").isNull(), "id", "t1", "t2"]
        sorted_ = unique.repartitionByRange(*order).sortWithinPartitions(*order)
        placed = written(sorted_.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
        sizes = {r["part"]: r for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.max("t2").alias("bytes"), F.max("rows").alias("rows")).collect()}  # a row for each task that wrote
        before, offsets = 0, []
        for part in range(max(sizes, default=-1) + 1):
            offsets.append(before)
            before += sizes[part]["n"] if part in sizes else 0
        self.width = max((r["bytes"] or 0 for r in sizes.values()), default=0) + 2
        if before * self.width >= 1 << 63:
            raise ValueError(f"{before} documents of up to {self.width} bytes don't fit into 64 bits")
        self.repeated = any(r["rows"] > 1 for r in sizes.values())
        start = F.get(F.split(F.lit(",".join(map(str, offsets or [0]))), ",").cast("array<long>"), F.col("part"))
        numbers = placed.select(F.col("id").alias("id_"), F.col("t1").alias("t1_"), F.col("t2").alias("t2_"), (start + F.col("at")).alias(self.number))
        i, a, b = (unused(docs, x) for x in ("id", "t1", "t2"))
        marked = docs.withColumns({i: marks[0], a: marks[1], b: marks[2]})
        names = [unused(marked, x) for x in ("k_id", "k_t1", "k_t2")]
        numbers = numbers.select(*[F.col(x).alias(y) for x, y in zip(("id_", "t1_", "t2_"), names)], self.number)
        same = F.col(i).eqNullSafe(F.col(names[0])) & (F.col(a) == F.col(names[1])) & F.col(b).eqNullSafe(F.col(names[2]))
        self.rows = written(marked.join(numbers, same).select(*docs.columns, self.number))
        released(placed)

    def texts(self) -> DataFrame:
        return self.rows.select(F.col(self.number).alias("d"), F.col(self.text).alias("text"))

    def document(self, c: str) -> Column:
        return F.expr(f"{c} div {self.width}L")

    def line(self, c: str) -> Column:
        return F.pmod(F.col(c), F.lit(self.width)).cast("int")

    def said(self, wanted: DataFrame) -> DataFrame:
        """(c, said) of the lines of wanted's c, each once."""
        wanted = written(wanted)
        places = wanted.groupBy(self.document("c").alias("d")).agg(F.collect_list(self.line("c")).alias("lines"))
        if wanted.count() <= BROADCAST_LINES:
            places = F.broadcast(places)
        found = self.texts().join(places, "d")
        each = let(F.split("text", "\n"), lambda all_lines: F.transform("lines", lambda i: F.struct(i.alias("i"), F.get(all_lines, i).alias("said"))))
        out = found.select("d", F.explode(each).alias("x")).select((F.col("d") * self.width + F.col("x.i")).alias("c"), "x.said")
        return out.dropDuplicates(["c"]) if self.repeated else out


def line_table(docs: Numbered, levels: Column, threshold: tuple[int, int], min_tokens: int) -> DataFrame:
    """(c, h1, h2, n, s0, s1, keys) of every line that may have min_tokens different words: two hashes of the line, the number of its
    words, parities, the prefix and one word more. Readers of the written table choose by n: pushed down here, the filter would have
    every line's words sorted twice."""
    lines = docs.texts().select("d", F.posexplode(F.split("text", "\n")).alias("i", "line")).select((F.col("d") * docs.width + F.col("i")).alias("c"), trimmed(F.col("line")).alias("said"))
    lines = lines.where(F.length("said") >= 2 * min_tokens - 1).select("c", F.xxhash64("said").alias("h1"), F.xxhash64(F.lit(1), "said").alias("h2"), keys_of(words_of(F.col("said"), BLANKS.replace(b"\n", b"")), levels).alias("keys"))
    s0, s1 = parities_of(F.col("keys"))
    n = F.size("keys")
    return lines.select("c", "h1", "h2", n.alias("n"), s0.alias("s0"), s1.alias("s1"), F.slice("keys", F.lit(1), prefix_length(n, *threshold) + 1).alias("keys"))


def _bits(d0: Column, d1: Column, least: Column) -> Column:
    """Differing parities, of 128 if both sets have more than SHORT words."""
    return F.when(least > SHORT, F.bit_count(d0.bitwiseXOR(d1)) + F.bit_count(d1)).otherwise(F.bit_count(d0))


def _alike(a: str, b: str, threshold: tuple[int, int]) -> Column:
    """Whether two sets may reach the threshold, by sizes and parities. Sets that do differ in at most (q - p) / (q + p) of their words
    together, and in no fewer words than bits of parity."""
    p, q = threshold
    of = lambda x: (F.col(f"{a}.{x}"), F.col(f"{b}.{x}"))
    (na, nb), (a0, b0), (a1, b1) = of("n"), of("s0"), of("s1")
    d0, d1 = a0.bitwiseXOR(b0), a1.bitwiseXOR(b1)
    bits = _bits(d0, d1, F.least(na, nb))
    return (q * F.least(na, nb) >= p * F.greatest(na, nb)) & (bits * (p + q) <= (q - p) * (na + nb))


def _nearest(classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(later, earlier): each class with the earliest of each part of those that share one of its prefix's least hashes."""
    prefix = F.slice("keys", F.lit(1), prefix_length(F.col("n"), *threshold))
    least = F.slice(F.sort_array(F.transform(prefix, lambda t: F.xxhash64(t))), 1, LEAST_HASHES)
    met = classes.select("c", "n", "s0", "s1", F.explode(least).alias("key"))
    shared = written(met.groupBy("key").agg(F.min("c").alias("c"), F.max("c").alias("last")).where("c < last").select("key"))
    met = written(met.join(shared, "key", "left_semi"))
    heads = met.groupBy("key", F.pmod(F.xxhash64("c"), F.lit(HEADS)).alias("part")).agg(F.min(F.struct("c", "n", "s0", "s1")).alias("b"))
    pairs = met.select("key", F.struct("c", "n", "s0", "s1").alias("a")).join(heads, "key").where((F.col("b.c") < F.col("a.c")) & _alike("a", "b", threshold))
    out = written(pairs.select(F.col("a.c").alias("later"), F.col("b.c").alias("earlier")).distinct())
    released(shared, met)
    return out


def _sides(classes: DataFrame, settled: DataFrame, threshold: tuple[int, int], heavy: int) -> DataFrame:
    """(c, n, s0, s1, settled, keys, small, large) of every class. small and large are the keys of sets with a heavy word in the prefix,
    for the two sides of the join; null where the words of the prefix are the keys."""
    p, q = threshold
    known = settled.withColumn("settled", F.lit(True))
    if settled.count() <= BROADCAST_LINES:
        known = F.broadcast(known)
    top = int(2 * math.log2(heavy)) if heavy else -1
    light = lambda t: F.shiftright(t, 63 - LEVEL_BITS) <= top

    def mixed(num: int, den: int) -> Column:
        most = prefix_length(F.col("n"), num, den)
        pairs = lambda t, i: F.transform(F.slice("keys", i + 2, most - i), lambda u: F.xxhash64(t, u))
        made = F.flatten(F.transform(F.slice("keys", F.lit(1), most), lambda t, i: F.when(light(t), F.array(t)).otherwise(pairs(t, i))))
        return F.when((F.col("n") > 1) & ~light(F.element_at("keys", most)), made)  # keys ascend: the prefix's last word is its heaviest

    return classes.join(known, "c", "left").select("c", "n", "s0", "s1", F.coalesce("settled", F.lit(False)).alias("settled"), "keys", mixed(2 * p, p + q).alias("small"), mixed(p, q).alias("large"))


def _entries(sides: DataFrame, made: str, num: int, den: int) -> DataFrame:
    """(key, c, about, s0, s1); about holds n, the key's place in the set and whether the class is settled."""
    n = F.col("n")
    keys = F.coalesce(F.col(made), F.slice("keys", F.lit(1), prefix_length(n, num, den)))
    entries = sides.select("c", "n", "settled", "s0", "s1", F.col(made).isNull().alias("plain"), F.posexplode(keys).alias("at", "key"))
    at = F.when(F.col("plain"), F.col("at")).otherwise(0)  # a bound, where words and pairs are mixed
    about = F.shiftleft(n.cast("long"), 32).bitwiseOR(F.shiftleft(at.cast("long"), 1)).bitwiseOR(F.col("settled").cast("long"))
    return entries.select("key", "c", about.alias("about"), "s0", "s1")


def _candidates(sides: DataFrame, threshold: tuple[int, int], above: int, up_to: int) -> DataFrame:
    """(later, earlier): pairs of classes that share a key and pass the filters, the later one not settled, the larger one's size in a
    range. The smaller set is looked up by a shorter prefix: it shares at least 2p / (p + q) of its words with a larger one."""
    p, q = threshold
    a = _entries(sides.where((F.col("n") * q >= p * above) & (F.col("n") <= up_to)), "small", 2 * p, p + q).alias("a")
    b = _entries(sides.where((F.col("n") > above) & (F.col("n") <= up_to)), "large", p, q).alias("b")

    def of(x: str, side: str) -> Column:
        about = F.col(f"{side}.about")
        return {"n": F.shiftright(about, 32), "at": F.shiftright(about.bitwiseAND(F.lit((1 << 32) - 1)), 1), "settled": about.bitwiseAND(F.lit(1))}[x]

    na, nb, ca, cb = of("n", "a"), of("n", "b"), F.col("a.c"), F.col("b.c")
    sizes = (q * na >= p * nb) & ((na < nb) | ((na == nb) & (ca < cb)))
    open_ = F.when(ca < cb, of("settled", "b")).otherwise(of("settled", "a")) == 0
    places = F.least(na - of("at", "a"), nb - of("at", "b")) * (p + q) >= p * (na + nb)
    d0, d1 = F.col("a.s0").bitwiseXOR(F.col("b.s0")), F.col("a.s1").bitwiseXOR(F.col("b.s1"))
    bits = _bits(d0, d1, na)
    pairs = b.join(a.hint("shuffle_hash"), (F.col("a.key") == F.col("b.key")) & sizes & open_ & places & (bits * (p + q) <= (q - p) * (na + nb)))
    return pairs.select(F.greatest("a.c", "b.c").alias("later"), F.least("a.c", "b.c").alias("earlier")).distinct()


def _words(docs: Numbered, pairs: DataFrame) -> DataFrame:
    """(c, words) of the lines of pairs (later, earlier)."""
    return docs.said(pairs.select(F.explode(F.array("later", "earlier")).alias("c")).distinct()).select("c", set_of(F.col("said")).alias("words"))


def _verified(words: DataFrame, pairs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(c): later classes of pairs whose words reach the threshold with the earlier one's."""
    p, q = threshold
    one, two = words.select(F.col("c").alias("later"), F.col("words").alias("w1")), words.select(F.col("c").alias("earlier"), F.col("words").alias("w2"))
    enough = F.size(F.array_intersect("w1", "w2")) * (p + q) >= p * (F.size("w1") + F.size("w2"))
    return pairs.select("later", "earlier").join(one, "later").join(two, "earlier").where(enough).select(F.col("later").alias("c")).distinct()


def size_ranges(sides: DataFrame, threshold: tuple[int, int], passes: int = PASSES) -> list[tuple[int, int]]:
    """Ranges (above, up to) of set sizes with about as many keys each."""
    p, q = threshold
    cuts = sides.agg(F.percentile("n", [i / passes for i in range(1, passes)], prefix_length(F.col("n"), p, q)).alias("at"), F.max("n").alias("most")).first()
    ends = sorted({0, *(int(x) for x in cuts["at"] or []), cuts["most"] or 0})
    return list(zip(ends, ends[1:]))


def matched_classes(docs: Numbered, lines: DataFrame, firsts: DataFrame, threshold: tuple[int, int] = THRESHOLD, heavy: int = HEAVY, done: DataFrame | None = None) -> DataFrame:
    """(c): classes that an earlier class reaches the threshold with; a written table. done: a table to release when lines are read."""
    classes = written(lines.select("c", "n", "s0", "s1", "keys").join(firsts.select("c"), "c"))
    released(*([done] if done is not None else []))
    near = _nearest(classes, threshold)
    words = written(_words(docs, near))
    settled = written(_verified(words, near, threshold))
    sides = written(_sides(classes, settled, threshold, heavy))
    released(near, words, classes)
    parts = [written(_candidates(sides, threshold, *r)) for r in size_ranges(sides, threshold)]
    if not parts:
        return settled
    pairs = parts[0]
    for x in parts[1:]:
        pairs = pairs.unionByName(x)
    released(sides)
    words = written(_words(docs, pairs))
    earliest = pairs.groupBy("later").agg(F.min("earlier").alias("earlier"))
    second = written(_verified(words, earliest, threshold))
    rest = pairs.join(second, F.col("later") == F.col("c"), "left_anti").join(earliest, ["later", "earlier"], "left_anti")
    out = written(settled.unionByName(second).unionByName(_verified(words, rest, threshold)))
    released(words, settled, second, *parts)
    return out


def dedup_lines(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, min_tokens: int = MIN_TOKENS, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """docs' rows with the text of the lines that stay, and n_lines, n_removed (of the input's lines)."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    known = Numbered(docs, id_col, text_col)
    every = written(line_table(known, word_levels(docs, text_col), threshold, max(1, min_tokens)))
    lines = every.where(F.col("n") >= min_tokens)
    firsts = written(lines.groupBy("h1", "h2").agg(F.min("c").alias("c"), F.max("c").alias("last")))
    # of a class every line but the first goes
    repeated = written(firsts.where("c < last").select("h1", "h2", F.col("c").alias("first")))
    copies = written(lines.select("c", "h1", "h2").join(repeated, ["h1", "h2"]).where("c <> first").select("c"))
    matched = matched_classes(known, lines, firsts, threshold, heavy, done=every)
    gone = written(copies.unionByName(matched).groupBy(known.document("c").alias("d")).agg(F.collect_set(known.line("c")).alias("lines")))
    released(firsts, repeated, copies, matched)
    names = {x: unused(known.rows, x) for x in ("d", "lines")}
    both = known.rows.join(gone.select(*[F.col(x).alias(y) for x, y in names.items()]), F.col(known.number) == F.col(names["d"]), "left")
    out, all_lines = F.col(names["lines"]), F.split(text_col, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), out)
    rest = let(all_lines, lambda x: F.transform(stay, lambda i: F.get(x, i)))
    text = F.when(out.isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    counts = {"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(all_lines)).cast("long"), "n_removed": F.coalesce(F.size(out), F.lit(0)).cast("long")}
    return both.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], *[v.alias(k) for k, v in counts.items()])
