"""Near-duplicate lines by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words (cut at white space, A-Z lower-cased).  A line is
removed if an earlier one, by doc_id and then line number, has at least
``PERCENT`` hundredths of Jaccard similarity with it; the earliest of a group of
equal sets stays.

Words are ordered by rarity, from counts over all documents (in 2**18 hashed bins,
so that the table has a fixed size; any one order gives right results).  Equal
sets become one class first.  Two similar sets share words among the first few of
that order, so only these prefixes are joined:

* length filter: of sizes n and m, the smaller is at least ``PERCENT`` hundredths of the larger;
* positional prefix: with ``need`` common words needed, a word counts up to place
  n - need + EXTRA, and of such places EXTRA at least have to agree (fewer where the
  prefix ends earlier): any word of the prefix that is lacking in the other set uses
  up one of the n - need that may lack;
* the words after the last common place bound what the sets can still share;
* each word flips one of 64 bits, so that two sets differ in as many words at least as their bits differ.

The pairs left are verified on their words, read again from the texts.

Every later line needs one match only.  So, before, each frequent word's earliest
line is compared with the others (one partner a line, the one with most words in
common); what that removes is compared with the lines that remain only.  Large families of
copies end there, which is linear, and no pair is left out.

Defined results: lines without a word are kept and match nothing; null and empty
texts stay; a text of any length is cut whole; rows with one doc_id are one place,
whose equal line numbers do not remove each other, but each loses only its own
lines; null doc_ids come first; repeated rows lose the same lines; extra columns are
kept, and the new column's name gets underscores where ``docs`` has it.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, narrow, table

PERCENT = 80
#: Common words asked of a pair's prefixes, where these are long enough.
EXTRA = 2
BIN_BITS = 18
#: Steps of rarity for each doubling of a bin's count.
STEPS = 4
#: Classes with a word in their prefix from which on its earliest one is tried first.
FREQUENT = 512
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_ID = -(2**63)


def _div(a: Column | str, b: Column) -> Column:
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, b)


def _ceil_div(a: Column, b: int) -> Column:
    return _div(a + (b - 1), F.lit(b))


def _lower(line: str) -> Column:
    """A-Z lower-cased.  lower() is much faster than translate(), and the same where a line has no other letter with a small form."""
    other = ~F.col(line).rlike(r"[[^\x00-\x7F]&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]")  # the range first: most characters end there
    return F.when((F.octet_length(line) == F.char_length(line)) | other, F.lower(line)).otherwise(F.translate(line, UPPER, UPPER.lower()))


def _words(line: str, lowered: Column) -> Column:
    """The words of a line, in order; an empty word may stand at its ends or between blanks."""
    odd = F.lit(False)
    for c in "\t\x0b\x0c\r":
        odd = odd | F.col(line).contains(c)
    return F.when(odd, F.split(lowered, "[ \t\x0b-\r]+")).otherwise(F.split(lowered, " "))


def _level(n: Column) -> Column:
    return F.least(F.lit(127), F.floor(F.log2(n + 1) * STEPS)).cast("int")


def rarity(docs: DataFrame) -> Column:
    """The frequency class of each bin as a constant array: 2**BIN_BITS small numbers, whatever the input.

    Words are counted with all letters lower-cased and cut at blanks and line ends, which is cheaper; a class may be any number.
    """
    word = docs.select(F.explode(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")).alias("w"))
    seen = word.select(F.shiftrightunsigned(F.xxhash64("w"), 64 - BIN_BITS).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    # packed 1,024 bins to a row, so that few rows come to the driver
    packed = seen.groupBy(F.shiftright("bin", 10).alias("page")).agg(F.array_join(F.collect_list((F.col("bin") * 128 + _level(F.col("n"))).cast("string")), ",").alias("s"))
    level = bytearray(1 << BIN_BITS)
    for row in packed.select("s").collect():
        for x in row["s"].split(","):
            level[int(x) >> 7] = int(x) & 127
    return F.split(F.lit(",".join(map(str, level))), ",").cast("array<tinyint>")


def _cut(docs: DataFrame) -> DataFrame:
    """(d, h, l, line): doc_id, a hash of the text, line number and line; not the empty ones."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    # hashed and cut before, so that a line's row does not carry the text
    rows = docs.select(d.alias("d"), F.xxhash64("text").alias("h"), F.split("text", "\n").alias("parts"))
    return rows.select("d", "h", F.posexplode("parts").alias("l", "line")).where("line != ''")


def lines(docs: DataFrame, level: Column, percent: int = PERCENT) -> DataFrame:
    """(d, h, l, c, e, n, prefix, parity) of each line: its row and number, the class (128 bits of a hash) and size of its set, its rarest words, and the parity bits of all.

    A word is its frequency class in 7 bits and 56 bits of its hash, so that the order of the numbers is the order by rarity.
    """

    def key(h: Column) -> Column:
        # never null, so that longs are sorted as such
        seen = F.coalesce(F.get(level, F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")).cast("long"), F.lit(0).cast("long"))
        return F.shiftleft(seen, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    hashes = F.transform(_words("line", _lower("line")), lambda w: F.xxhash64(w))
    words = F.array_remove(F.array_distinct(F.sort_array(F.transform(hashes, key))), key(F.xxhash64(F.lit(""))))
    rows = _cut(docs).select("d", "h", "l", words.alias("s"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))  # noqa: E731  by the lowest 6 bits
    parity = F.aggregate("s", F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(bit(x)))
    n = F.size("s")
    keep = F.when(n * (100 - percent) >= percent, n - _ceil_div(n * percent, 100).cast("int") + 1).otherwise(0)  # a smaller set has no similar one but equals
    return rows.select("d", "h", "l", F.xxhash64("s").alias("c"), F.xxhash64(F.lit(1), "s").alias("e"), n.alias("n"), F.slice("s", F.lit(1), keep).alias("prefix"), parity.alias("parity"))


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _need(n: Column, m: Column, percent: int) -> Column:
    return _ceil_div((n + m) * percent, 100 + percent)


def _near(n: Column, m: Column, odd: Column, other: Column, percent: int) -> Column:
    """Whether the parity bits let two sets be similar: these differ in at most (n + m) (100 - percent) / (100 + percent) words."""
    return F.bit_count(odd.bitwiseXOR(other)) * (100 + percent) <= (n + m) * (100 - percent)


def _places(n: Column, need: Column, percent: int) -> Column:
    """The last place of a set's prefix that counts for a pair that needs so many common words."""
    return F.least(n - _ceil_div(n * percent, 100) + 1, n - need + EXTRA)


def candidates(heads: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the classes (id, n, prefix, parity, gone) that pass all filters and are not both gone."""
    # size, place and mark in one number: millions of these rows are shuffled
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("p") + 1, 1)).bitwiseOR(F.col("gone").cast("int"))
    words = heads.select(F.posexplode("prefix").alias("p", "token"), "id", "n", "gone", "parity").select("token", "id", packed.alias("at"), "parity")
    a, b = words.alias("a"), words.alias("b")
    (n, p, x), (m, q, y) = ((F.shiftright(f"{s}.at", 32).cast("int"), F.shiftright(F.col(f"{s}.at").bitwiseAND(F.lit(0xFFFFFFFF)), 1), F.col(f"{s}.at").bitwiseAND(F.lit(1))) for s in "ab")
    need = _need(n, m, percent)
    fits = _sizes_fit(n, m, percent) & (x + y < 2) & (p <= n - need + EXTRA) & (q <= m - need + EXTRA)
    near = _near(n, m, F.col("a.parity"), F.col("b.parity"), percent)
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & near & fits)  # near is cheap and refuses most
    pairs = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), n.alias("n"), m.alias("m"), p.alias("p"), q.alias("q"))
    pairs = pairs.groupBy("a", "b", "n", "m").agg(F.count("*").alias("k"), F.max("p").alias("p"), F.max("q").alias("q"))
    n, m = F.col("n"), F.col("m")
    need = _need(n, m, percent)
    least = F.least(_places(n, need, percent) - n + need, _places(m, need, percent) - m + need)
    return pairs.where((F.col("k") >= least) & (F.col("k") + F.least(n - F.col("p"), m - F.col("q")) >= need)).select("a", "b")


def first_partners(heads: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(a, b): of each class with frequent words in its prefix, the earliest class of such a word with which it shares most of them."""
    words = heads.select("id", "n", "d", "l", "parity", F.explode("prefix").alias("token"))
    # a word in so many sets is in a bin of that count at least
    often = words.where(F.shiftright("token", 56) >= int(log2(FREQUENT + 1) * STEPS))
    first = narrow(often.groupBy("token").agg(F.count("*").alias("k"), F.min("d").alias("first")).where(F.col("k") > FREQUENT).select("token", "first"), scratch)
    pivot = often.join(first, "token").where(F.col("d") == F.col("first")).groupBy("token").agg(F.min(F.struct("l", "id", "n", "parity")).alias("f"))
    pivot = narrow(pivot.select("token", F.col("f.id").alias("b"), F.col("f.n").alias("m"), F.col("f.parity").alias("odd")), scratch)
    n, m = F.col("n"), F.col("m")
    pairs = often.join(pivot, "token").where((F.col("id") != F.col("b")) & _sizes_fit(n, m, percent) & _near(n, m, F.col("parity"), F.col("odd"), percent))
    pairs = pairs.groupBy("id", "b").agg(F.count("*").alias("k")).groupBy("id").agg(F.max(F.struct("k", "b")).alias("f"))
    return pairs.select(F.col("id").alias("a"), F.col("f.b").alias("b"))


def confirmed(pairs: DataFrame, heads: DataFrame, docs: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The id of the later class of each pair whose sets of words are similar."""
    pairs = scratch.save(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    need = heads.select("id", "d", "h", "l").join(narrow(ids, scratch), "id").groupBy("d", "h").agg(F.collect_list(F.struct("id", "l")).alias("wanted"))
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select("text", d.alias("d"), F.xxhash64("text").alias("h")).join(narrow(need, scratch), ["d", "h"])
    # a text is cut once: its lines are a lambda's variable
    pick = lambda parts: F.transform("wanted", lambda x: F.struct(x["id"].alias("id"), x["l"].alias("l"), F.get(parts, x["l"]).alias("line")))
    rows = rows.select("d", F.explode(F.get(F.transform(F.array(F.split("text", "\n")), pick), F.lit(0))).alias("x")).select("d", "x.*")
    # repeated rows give a line again: one stays; lines are shuffled once, by id, for both sides of the pairs
    sets = rows.groupBy("id").agg(F.max(F.struct("d", "l", "line")).alias("x")).select("id", "x.*")
    words = lambda line: F.array_remove(F.array_distinct(_words(line, _lower(line))), "")
    first = sets.select(F.col("id").alias("a"), F.struct("d", "l").alias("pa"), F.col("line").alias("la"))
    second = sets.select(F.col("id").alias("b"), F.struct("d", "l").alias("pb"), words("line").alias("wb"))
    # a pair carries the line to its second join, which is shorter than its words; these are a lambda's variable, so that it is cut once
    similar = lambda wa: F.size(F.array_intersect(wa, "wb")) * (100 + percent) >= (F.size(wa) + F.size("wb")) * percent
    both = pairs.join(first, "a").join(second, "b").where((F.col("pa") != F.col("pb")) & F.get(F.transform(F.array(words("la")), similar), F.lit(0)))
    out = scratch.save(both.select(F.when(F.col("pa") > F.col("pb"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct(), "gone")
    scratch.drop(pairs)
    return out


def removals(docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """(d, h, l) of every line that an earlier line removes: another row of the same doc_id keeps its own line l."""
    docs = docs.select("doc_id", "text").where("text is not null")
    rows = scratch.save(lines(docs, rarity(docs), percent), "lines").where("n > 0")
    # most classes have one line, which is their head: only the others are ordered and joined
    copied = narrow(rows.groupBy("c", "e").agg(F.count("*").alias("k")).where("k > 1").select("c", "e"), scratch)
    copies = rows.join(copied, ["c", "e"])
    earliest = F.row_number().over(Window.partitionBy("c", "e").orderBy("d", "l", "h"))
    firsts = copies.withColumn("k", earliest).where("k = 1").drop("k").withColumn("several", F.lit(True))
    heads = rows.join(copied, ["c", "e"], "left_anti").withColumn("several", F.lit(False)).unionByName(firsts)
    heads = scratch.save(heads.withColumn("id", F.monotonically_increasing_id()), "heads")
    usable = heads.where(F.size("prefix") > 0)
    gone = confirmed(first_partners(usable, scratch, percent), usable, docs, scratch, percent)
    marked = usable.select("id", "n", "prefix", "parity").join(narrow(gone.withColumn("gone", F.lit(True)), scratch), "id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    more = confirmed(candidates(marked, percent), usable, docs, scratch, percent)
    gone = narrow(gone.unionByName(more).distinct().withColumn("gone", F.lit(True)), scratch)
    alone = heads.where("not several").join(gone, "id").select("d", "h", "l")
    first = narrow(heads.where("several").join(gone, "id", "left").select("c", "e", F.col("d").alias("hd"), F.col("l").alias("hl"), F.coalesce("gone", F.lit(False)).alias("gone")), scratch)
    later = F.struct("d", "l") > F.struct(F.col("hd").alias("d"), F.col("hl").alias("l"))
    return rows.select("d", "h", "l", "c", "e").join(first, ["c", "e"]).where(F.col("gone") | later).select("d", "h", "l").unionByName(alone)


def remove_lines(docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``, and their number as ``n_removed`` (with underscores added if ``docs`` has that column)."""
    key, name, cut, number = fresh(docs, "_d"), fresh(docs, "_h"), fresh(docs, "_gone"), fresh(docs, "n_removed")
    gone = removals(docs, scratch, percent).groupBy("d", "h").agg(F.collect_set("l").alias(cut))
    gone = narrow(gone.withColumnsRenamed({"d": key, "h": name}), scratch)
    scratch.keep(gone)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(name, F.xxhash64("text"))
    out = keyed.join(gone, [key, name], "left")

    def without(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(cut))
        return F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")

    # the lines as a lambda's variable: a text is cut once, and not again for each line
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.get(F.transform(F.array(F.split("text", "\n")), without), F.lit(0)))
    n = F.when(F.col(cut).isNull(), F.lit(0)).otherwise(F.size(cut))
    return out.withColumn(number, n.cast("long")).withColumn("text", text).select(*docs.columns, number)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    return remove_lines(n, Scratch(spark, "lines")).select("doc_id", "n_lines", "n_removed", "text")
