"""Order MinHash: fingerprints of texts whose likeness follows their edit distance.

A text is cut into words, its k-mers are runs of words, and equal k-mers are numbered by occurrence, so
that repeats count. Under an order of all numbered k-mers by hash, the least ``tuple_size`` of a text are
selected, put back in the order in which they stand in it, and hashed together: a place of the signature. The
orders of the places are rotations of one another, so one sort of a text's hashes serves all of them,
and each place starts with a binary search. Everything is a Column expression within a row.

A k-mer is a BIGINT: 39 bits of hash, then 24 bits of its place. Sorting these sorts by hash and, within
equal k-mers, by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import let
from topicloom.llm.common import SPACE_CLASS, staged
from topicloom.operators.scans import positioned

#: Words of a k-mer, k-mers of a tuple, places of a signature (a power of two).
WORDS, TUPLE, PLACES = 2, 2, 64
HASH_BITS, PLACE_BITS = 39, 24
#: Scripts without spaces: each character is a word. Longer runs of other characters are cut at so many.
CHARACTERS, LONGEST = r"⺀-鿿가-힯豈-﫿", 16
#: Steps of a binary search, as long as an array can be.
_STEPS = [1 << i for i in reversed(range(31))]


def words(text: Column) -> Column:
    """The words of a text: runs without white space, cut after LONGEST characters, and single characters of scripts without spaces."""
    # only words that are long or hold a three-byte character are searched by the pattern
    wide = lambda w: (F.length(w) > LONGEST) | ((F.octet_length(w) >= F.length(w) + 2) & F.rlike(w, F.lit(f"[{CHARACTERS}]")))
    cut = lambda w: F.filter(F.split(F.regexp_replace(w, rf"([{CHARACTERS}]|[^{CHARACTERS}]{{{LONGEST}}})", "$1 "), " "), lambda x: x != "")
    pieces = lambda ws: F.flatten(F.transform(ws, lambda w: F.when(wide(w), cut(w)).otherwise(F.array(w))))
    plain = F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")
    return let(plain, lambda ws: F.when(F.exists(ws, wide), pieces(ws)).otherwise(ws))


def _hash(*values: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*values), 64 - HASH_BITS)


def _packed(hash_: Column, place: Column) -> Column:
    return F.shiftleft(hash_, PLACE_BITS).bitwiseOR(place)


def _kmers(w: Column, k: int) -> Column:
    """The sorted packed k-mers of an array of words; fewer than ``k`` words are one k-mer, none give none.

    Places beyond 24 bits lose their last bits, so that very long texts have places too.
    """
    spare = F.greatest(F.lit(0), F.length(F.bin(F.size(w).cast("bigint"))) - PLACE_BITS)
    place = lambda i: F.call_function("shiftright", i.cast("bigint"), spare)
    of = lambda x, i: _packed(_hash(x, *[F.get(w, i + j) for j in range(1, k)]), place(i))
    return F.sort_array(F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), of))


def _same(a: Column, b: Column) -> Column:
    return F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)


def _numbered(s: Column) -> Column:
    """Sorted k-mers with equal ones told apart: the first keeps its hash, each later one gets that of its number.

    Equal ones stand side by side, so how many of them stand before one is found by doubling steps.
    """
    again = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda j: _same(F.get(s, j), F.get(s, j - 1)))

    def number(j):
        steps = F.filter(F.array(*[F.lit(x) for x in _STEPS]), lambda x: x <= j)
        return F.aggregate(steps, F.lit(0), lambda o, x: F.when((o + x <= j) & _same(F.get(s, j - o - x), F.get(s, j)), o + x).otherwise(o))

    def later(j):
        return _packed(_hash(F.shiftright(F.get(s, j), PLACE_BITS), number(j)), F.get(s, j).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))

    first = F.filter(s, lambda x, j: (j == 0) | ~F.coalesce(_same(x, F.get(s, j - 1)), F.lit(False)))
    renamed = let(again, lambda js: F.when(F.size(js) == 0, s).otherwise(F.sort_array(F.concat(first, F.transform(js, later)))))
    return F.when(F.size(s) < 2, s).otherwise(renamed)


def _tuples(s: Column, size: int, places: int) -> Column:
    """The signature: for each place a hash of the ``size`` k-mers at or after its start, round the circle of hashes, in the order of the text."""
    steps = F.filter(F.array(*[F.lit(x) for x in _STEPS]), lambda x: x <= F.size(s))
    wide = 1 << (HASH_BITS + PLACE_BITS)

    def signature(steps):
        def at(b):
            start = (b * F.lit(wide // places)).cast("bigint")
            return F.aggregate(steps, F.lit(0), lambda j, x: F.when((j + x <= F.size(s)) & (F.get(s, j + x - 1) < start), j + x).otherwise(j))

        def value(b):
            chosen = lambda j: [F.get(s, (j + i) % F.size(s)) for i in range(size)]
            turned = lambda x: F.shiftleft(x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)), HASH_BITS).bitwiseOR(F.shiftright(x, PLACE_BITS))
            return let(at(b), lambda j: F.xxhash64(F.transform(F.array_sort(F.array_distinct(F.transform(F.array(*chosen(j)), turned))), lambda x: x.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))))

        return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(places - 1).cast("bigint")), value)

    none = F.transform(F.sequence(F.lit(1), F.lit(places)), lambda _: F.lit(0).cast("bigint"))
    return F.when(F.size(s) == 0, none).otherwise(let(steps, signature))


def fingerprint(text: Column, k: int = WORDS, size: int = TUPLE, places: int = PLACES) -> Column:
    """The signature of a whole text as hexadecimal digits, 8 a place. Null counts as empty; texts without words have zeros.

    Equal texts have equal fingerprints. A text's words and hashes are held at once, some 100 bytes a word.
    """
    w = words(F.coalesce(text, F.lit("")))
    sig = let(let(let(w, lambda x: F.when(F.size(x) == 0, F.array().cast("array<bigint>")).otherwise(_kmers(x, k))), _numbered), lambda s: _tuples(s, size, places))
    return F.array_join(F.transform(sig, lambda x: F.substring(F.lpad(F.hex(x), 16, "0"), 9, 8)), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of places at which two fingerprints agree, 0 to 1."""
    starts = F.sequence(F.lit(1), F.length(a), F.lit(8))
    same = F.filter(starts, lambda i: F.substring(a, i, F.lit(8)) == F.substring(b, i, F.lit(8)))
    return F.size(same) / F.size(starts)


#: Documents that stand together, and in order, when each is given what follows it.
RUN = 1024


def neighbours(df: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """``(key, n_chars, fingerprint, text_head, next_head, next_fingerprint)``: each row beside the next one by ascending key, the last beside the first.

    ``text_head`` is the first ceil(n / 2) code points, ``next_head`` the first floor(n / 2) of the next row's
    text, or all. Null texts count as empty. Rows of one key go by a hash of their texts, then by ``row``; null
    keys come last. ``row`` names a column that tells all rows apart and is the same at each reading, such as
    file and place of a Parquet row; without one, a copy of the texts is written. Rows are put in order by
    keys alone; then runs of RUN rows in order meet, each with the first row of the next run. No key gathers:
    places are all different. An empty table gives no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), t.alias("t"))
    rows = rows if row else staged(rows, "minhash-texts")
    placed = staged(positioned(rows.select("row", F.length("t").alias("n"), F.col("key").alias("k"), F.xxhash64("t").alias("h")), F.asc_nulls_last("k"), "h", "row").select("row", "n", "pos"), "minhash-places")
    count = placed.count()
    half = F.floor(F.col("n") / 2).cast("int")
    before = placed.select(((F.col("pos") + 1) % max(count, 1)).alias("pos"), half.alias("asked"))
    # fingerprints are made where texts are read, and travel as bytes; then texts lose what neither they nor the one before need
    printed = rows.select("key", "row", "t", F.unhex(fingerprint(F.col("t"))).alias("fp"))
    both = printed.join(placed.join(before, "pos"), "row")
    both = both.select("key", "n", "fp", "pos", F.left("t", F.greatest(F.col("n") - half, F.col("asked"))).alias("head"))
    run = lambda pos: F.struct(pos.alias("pos"), F.floor(pos / RUN).alias("run"))
    last = F.when(F.col("pos") == 0, F.lit(count)).otherwise(F.col("pos"))
    # the first row of a run stands behind the run before it too
    behind = F.struct(last.alias("pos"), F.floor((last - 1) / RUN).alias("run"))
    places = F.when(F.col("pos") % RUN == 0, F.array(run(F.col("pos")), behind)).otherwise(F.array(run(F.col("pos"))))
    each = both.select("key", "n", "fp", "head", F.posexplode(places).alias("copy", "at"))
    after = Window.partitionBy("at.run").orderBy("at.pos")
    found = each.withColumn("next", F.lead(F.struct("head", "fp")).over(after)).where("copy = 0")
    return found.select(F.col("key").alias(key), F.col("n").cast("bigint").alias("n_chars"), F.hex("fp").alias("fingerprint"), F.left("head", F.col("n") - half).alias("text_head"), F.left("next.head", half).alias("next_head"), F.hex("next.fp").alias("next_fingerprint"))
