"""Phrases of two to four words that occur more often than their parts suggest.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and pieces into words at
spaces and tabs. Per language (null: ``und``), f(phrase) counts contiguous occurrences
within pieces, overlaps included. A candidate has f at least ``LEAST``. Cut after its
first k words, its score is 2,000,000 f(phrase) / (f(first part) + f(rest)), rounded
down; the cut that scores least counts, of equal ones the shortest first part. A candidate inside
a longer one that occurs at least ``KEPT`` % as often is left out.

Counting is exact and works on shards, runs of documents of about ``SHARD_BYTES`` of text:

1. Each shard numbers its words. Words are counted over all shards; those below
   ``LEAST`` end a piece from here on, as no candidate holds them. The others get ids,
   which go back to the shards that hold the word.
2. Each shard counts its pairs of words in a counting quotient filter (``quotient``), cut into
   buckets of quotients. Buckets are merged across shards, and each shard is told
   which of its pairs are candidates.
3. Three words are counted only where both pairs in them are candidates, four words
   only where both threes are: a phrase is never more frequent than its parts. So
   filters shrink with length, and nothing is lost.

No list of words or phrases is broadcast or collected, whatever its length: shards are told by
a join and a shuffle. The number of buckets grows with the text, so that the filters
one task merges stay in its memory.

Defined results: null and empty texts have no words; a language without candidates has no
row; rows that repeat or share a ``doc_id`` count each; documents without an id
count too; other columns are ignored; an empty table gives no rows. A piece of any
length is counted whole; one text is held in Python at a time beside its shard.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from pairsim.llm import quotient
from pairsim.operators.lookup import lookup
from pairsim.operators.position import with_position
from pairsim.sources.scratch import durable

LEAST = 30
LONGEST = 4
KEPT = 80
SCALE = 2_000_000
TOP = 2000
#: Text that one shard holds, and that one bucket of quotients stands for.
SHARD_BYTES, BUCKET_BYTES = 12 << 20, 8 << 20
UNKNOWN = "und"
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: A gap between pieces; as it ends pieces it is no word.
_GAP = b" . "

_SHARDS = pa.schema(
    [
        ("shard", pa.int64()),
        ("lang", pa.string()),
        ("word", pa.string()),
        ("local", pa.int32()),
        ("n", pa.int64()),
        ("stream", pa.binary()),
    ]
)


def _squeezed(numbers: np.ndarray) -> bytes:
    data = numbers.tobytes()
    packed = pa.compress(data, codec="zstd", asbytes=True)
    return len(data).to_bytes(8, "little") + packed


def _numbers(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), kind)


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and, in order, each word's number from 1; 0 between pieces."""
    data = _GAP.join(t.translate(_BYTES) for t in texts).replace(b".", _GAP)
    sizes = pa.py_buffer(np.array([0, len(data)], np.int64).tobytes())
    text = pa.Array.from_buffers(pa.large_string(), 1, [None, sizes, pa.py_buffer(data)])
    encoded = pc.ascii_split_whitespace(text).flatten().dictionary_encode()
    known, at = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
    # The gap and the empty strings at either end are no words.
    real = pc.and_(pc.not_equal(known, "."), pc.not_equal(known, "")).to_numpy(zero_copy_only=False)
    empty = pc.equal(known, "").to_numpy(zero_copy_only=False)
    numbers = np.where(real, np.cumsum(real), 0).astype(np.int32)
    return known.filter(pa.array(real)), numbers[at[~empty[at]]]


def _shard(number: int, texts: dict[str, list[bytes]]):
    """Rows of one shard: its words by language, and the stream of their numbers."""
    streams, offset = [], 0
    for lang, mine in texts.items():
        words, stream = words_of(mine)
        n = len(words)
        if n:
            counts = np.bincount(stream, minlength=n + 1)[1:]
            columns = [
                pa.array(np.full(n, number)),
                pa.array([lang] * n, pa.string()),
                words.cast(pa.string()),
                pa.array(np.arange(offset + 1, offset + n + 1, dtype=np.int32)),
                pa.array(counts.astype(np.int64)),
                pa.nulls(n, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_SHARDS)
        streams += [np.where(stream > 0, stream + offset, 0).astype(np.int32), np.zeros(1, np.int32)]
        offset += n
    if offset:
        row = [[number], [None], [None], [None], [None], [_squeezed(np.concatenate(streams))]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _SHARDS)], schema=_SHARDS)


def _shard_batches(batches):
    # Written once; a number names a shard within the table that its task has written.
    number, size, texts = TaskContext.get().partitionId() << 32, 0, {}
    for batch in batches:
        langs = batch.column(0)
        values = batch.column(1).cast(pa.binary())
        for i in range(batch.num_rows):
            text = values[i].as_py()
            if not text:
                continue
            texts.setdefault(langs[i].as_py(), []).append(text)
            size += len(text)
            if size >= SHARD_BYTES:
                yield from _shard(number, texts)
                number, size, texts = number + 1, 0, {}
    if texts:
        yield from _shard(number, texts)


_LEVEL = pa.schema(
    [("shard", pa.int64()), ("bucket", pa.int64()), ("filter", pa.binary()), ("stream", pa.binary()), ("open", pa.binary())]
)


def _level_table(shard: int, filters, stream: bytes | None, opened: np.ndarray | None) -> pa.Table:
    """A shard's filter by buckets and, in a row without a bucket, what it goes on with."""
    found = list(filters)
    rows = [(shard, b, f, None, None) for b, f in found]
    if stream is not None:
        bits = None if opened is None else np.packbits(opened).tobytes()
        rows.append((shard, None, None, stream, bits))
    columns = zip(*rows, strict=True) if rows else [[] for _ in _LEVEL]
    return pa.table([pa.array(list(v), f.type) for v, f in zip(columns, _LEVEL)], schema=_LEVEL)


def _grams(ids: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    return quotient.pack([ids[at + i] for i in range(n)])


def _pairs(bucket_bits: int):
    """Global ids in place of a shard's numbers, and its filter of pairs."""

    def run(streams: pa.Table, told: pa.Table) -> pa.Table:
        if not streams.num_rows or not told.num_rows:
            return _level_table(0, [], None, None)
        shard = streams["shard"][0].as_py()
        local = _numbers(streams["stream"][0].as_py(), np.int32)
        table = np.zeros(int(local.max(initial=0)) + 1, np.uint32)
        table[told["local"].to_numpy()] = told["id"].to_numpy().astype(np.uint32)
        ids = table[local]
        both = (ids[:-1] > 0) & (ids[1:] > 0)
        filters = quotient.buckets_of(*quotient.count(_grams(ids, np.flatnonzero(both), 2)), bucket_bits)
        return _level_table(shard, filters, _squeezed(ids), None)

    return run


def _longer(n: int, bucket_bits: int):
    """A shard's filter of ``n`` words, given which of its grams of ``n - 1`` are candidates."""

    def run(streams: pa.Table, told: pa.Table) -> pa.Table:
        if not streams.num_rows or not told.num_rows:
            return _level_table(0, [], None, None)
        shard = streams["shard"][0].as_py()
        ids = _numbers(streams["stream"][0].as_py(), np.uint32)
        bits = streams["open"][0].as_py()
        if bits is None:
            may = ids > 0
            may[:-1] &= may[1:]
            may[-1:] = False
        else:
            # A gram of n - 1 words can begin where two candidates of n - 2 overlap.
            may = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(ids)).astype(bool)
            may[:-1] &= may[1:]
            may[-1:] = False
        at = np.flatnonzero(may)
        known = [np.concatenate(k) for k in zip(*[_read_keys(x.as_py()) for x in told["keys"]], strict=True)]
        ranks = quotient.order(known)
        opened = np.zeros(len(ids), bool)
        opened[at[quotient.members(_grams(ids, at, n - 1), [k[ranks] for k in known])]] = True
        longer = np.flatnonzero(opened[:-1] & opened[1:])
        filters = quotient.buckets_of(*quotient.count(_grams(ids, longer, n)), bucket_bits)
        return _level_table(shard, filters, streams["stream"][0].as_py() if n < LONGEST else None, opened)

    return run


def _written_keys(keys: list[np.ndarray]) -> bytes:
    return bytes([len(keys)]) + b"".join(k.astype("<u8").tobytes() for k in keys)


def _read_keys(data: bytes) -> list[np.ndarray]:
    return list(np.frombuffer(data[1:], "<u8").astype(np.uint64).reshape(data[0], -1))


_MERGED = pa.schema(
    [("shard", pa.int64()), ("keys", pa.binary()), ("high", pa.int64()), ("low", pa.int64()), ("f", pa.int64())]
)


def _merged(least: int):
    """The candidates of one bucket, and for each shard those that it holds."""

    def run(table: pa.Table) -> pa.Table:
        shards = table["shard"].to_numpy()
        filters = [quotient.read_bucket(x.as_py()) for x in table["filter"]]
        keys, counts, group = quotient.merge(filters)
        often = counts >= least
        rows, end = [], 0
        for shard, (mine, _) in zip(shards.tolist(), filters):
            start, end = end, end + len(mine[0])
            held = often[group[start:end]]
            if held.any():
                rows.append((shard, _written_keys([k[held] for k in mine])))
        high, low = quotient.unpack([k[often] for k in keys])
        n, m = len(rows), len(high)
        columns = [
            pa.array([r[0] for r in rows] + [None] * m, pa.int64()),
            pa.array([r[1] for r in rows] + [None] * m, pa.binary()),
            *[
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(v.astype(np.int64))])
                for v in (high.view(np.int64), low.view(np.int64), counts[often])
            ],
        ]
        return pa.table(columns, schema=_MERGED)

    return run


def _bucket_bits(docs: DataFrame) -> int:
    """Buckets enough that the filters of one stand for about ``BUCKET_BYTES`` of text."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return max(4, (size // BUCKET_BYTES).bit_length())


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All words ``(lang, word, n)``, those with ids ``(id, lang, word, n)``, and the
    candidates ``(high, low, f)`` of packed ids."""
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    bits = _bucket_bits(texts)
    shards = durable(texts.mapInArrow(_shard_batches, from_arrow_schema(_SHARDS)))
    held = shards.where(F.col("stream").isNull())
    words = durable(held.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    frequent = with_position(words.where(F.col("n") >= least), ["lang", "word"], name="id")
    many = F.raise_error(F.lit("more frequent words than 32-bit ids"))
    frequent = durable(frequent.withColumn("id", F.when(F.col("id") < (1 << 32) - 1, F.col("id") + 1).otherwise(many)))
    mapped = held.select("shard", "lang", "word", "local").join(frequent, ["lang", "word"])
    told = mapped.select(F.col("shard").alias("holder"), "local", "id")
    streams = shards.where(F.col("stream").isNotNull()).select("shard", "stream")
    step = _pairs(bits)
    found = []
    for n in range(2, LONGEST + 1):
        level = durable(
            streams.groupBy("shard").cogroup(told.groupBy("holder")).applyInArrow(step, from_arrow_schema(_LEVEL))
        )
        buckets = level.where(F.col("bucket").isNotNull()).select("shard", "bucket", "filter")
        merged = durable(buckets.groupBy("bucket").applyInArrow(_merged(least), from_arrow_schema(_MERGED)))
        found.append(merged.where(F.col("shard").isNull()).select("high", "low", "f"))
        streams = level.where(F.col("stream").isNotNull()).select("shard", "stream", "open")
        told = merged.where(F.col("shard").isNotNull()).select(F.col("shard").alias("holder"), "keys")
        step = _longer(n + 1, bits)
    grams = found[0]
    for more in found[1:]:
        grams = grams.unionAll(more)
    return words, frequent, durable(grams)


def _ids(high: str = "high", low: str = "low") -> Column:
    """Ids of a packed gram as an array."""
    halves = [F.shiftrightunsigned(high, 32), F.col(high).bitwiseAND(0xFFFFFFFF)]
    halves += [F.shiftrightunsigned(low, 32), F.col(low).bitwiseAND(0xFFFFFFFF)]
    return F.filter(F.array(*halves), lambda x: x > 0)


def _gram(ids: Column, start: Column, n: Column) -> Column:
    """Packed key of ``n`` ids from place ``start`` (from 0); a single word is one too."""

    def at(i: int) -> Column:
        return F.when(n > i, F.get(ids, start + i)).otherwise(F.lit(0).cast("long"))

    return F.struct(
        F.shiftleft(at(0), 32).bitwiseOR(at(1)).alias("high"), F.shiftleft(at(2), 32).bitwiseOR(at(3)).alias("low")
    )


def _kept(grams: DataFrame) -> DataFrame:
    """Candidates that are in no longer one of about their frequency."""
    size = F.size("ids")
    places = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda n: F.transform(F.sequence(F.lit(0), size - n), lambda s: _gram(F.col("ids"), s, n)),
        )
    )
    inner = grams.where(size > 2).select(F.explode(places).alias("key"), "f")
    most = inner.groupBy("key").agg(F.max("f").alias("longer"))
    joined = grams.join(most, "key", "left")
    return joined.where(F.coalesce(100 * F.col("longer") < KEPT * F.col("f"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language
    of ``docs(lang, text)`` by score, frequency, then phrase."""
    words, frequent, grams = phrase_counts(docs, least)
    grams = grams.select(F.struct("high", "low").alias("key"), "f", _ids().alias("ids"))
    zero = F.lit(0).cast("long")
    single = F.struct(F.shiftleft("id", 32).alias("high"), zero.alias("low"))
    counts = durable(grams.select("key", "f").unionAll(frequent.select(single.alias("key"), F.col("n").alias("f"))))

    kept = durable(_kept(grams))
    size = F.size("ids")
    cuts = kept.select("key", "f", "ids", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        F.col("key").alias("gram"), F.col("f").alias("a"), "k",
        _gram(F.col("ids"), F.lit(0), F.col("k")).alias("first"),
        _gram(F.col("ids"), F.col("k"), size - F.col("k")).alias("rest"),
    )
    first = counts.select(F.col("key").alias("first"), F.col("f").alias("l"))
    rest = counts.select(F.col("key").alias("rest"), F.col("f").alias("r"))
    cuts = lookup(lookup(cuts, first, "first", ["gram", "k"]), rest, "rest", ["gram", "k"])
    wide = F.col("a").cast("decimal(20,0)") * F.lit(SCALE)
    scored = cuts.withColumn("wide", wide).withColumn("score", F.expr("wide div (l + r)").cast("long"))
    best = scored.groupBy("gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    named = kept.select("key", F.posexplode("ids").alias("place", "id"))
    named = lookup(named, frequent.select("id", "lang", "word"), "id", ["key"])
    phrases = named.groupBy("key").agg(
        F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words")
    )
    phrase = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    found = phrases.select("key", "lang", phrase.alias("phrase")).join(
        best.select(F.col("gram").alias("key"), "a", "cut.score", "cut.l", "cut.r"), "key"
    )
    ordered = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Spark keeps the first rows of each task before the languages are dealt.
    first = durable(found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def _cuts_sql() -> str:
    """All cuts of all candidates, each with its parts as texts."""
    return " UNION ALL ".join(
        f"""SELECT lang, phrase, a, {k} AS k, list_aggregate(w[1:{k}], 'string_agg', ' ') AS first,
            list_aggregate(w[{k + 1}:{n}], 'string_agg', ' ') AS rest
            FROM c WHERE n_words = {n}"""
        for n in range(2, LONGEST + 1)
        for k in range(1, n)
    )


def _inner_sql() -> str:
    """All shorter phrases of two words and more inside each candidate."""
    return " UNION ALL ".join(
        f"SELECT lang, a, list_aggregate(w[{i}:{i + m - 1}], 'string_agg', ' ') AS phrase FROM c WHERE n_words = {n}"
        for n in range(3, LONGEST + 1)
        for m in range(2, n)
        for i in range(1, n - m + 2)
    )


COLLOCATION_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (
  SELECT lang, row_number() OVER () AS piece,
    list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
t AS (SELECT lang, piece, unnest(w) AS a, unnest(range(len(w))) AS i FROM p),
g AS MATERIALIZED (
  SELECT lang, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d
  FROM t WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (
  SELECT lang, 1 AS n_words, a AS phrase, count(*) AS f FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, a || ' ' || b AS x, count(*) FROM g WHERE b IS NOT NULL GROUP BY lang, x
  UNION ALL SELECT lang, 3, concat_ws(' ', a, b, c) AS x, count(*) FROM g WHERE c IS NOT NULL GROUP BY lang, x
  UNION ALL SELECT lang, 4, concat_ws(' ', a, b, c, d) AS x, count(*) FROM g WHERE d IS NOT NULL GROUP BY lang, x),
c AS MATERIALIZED (
  SELECT lang, n_words, phrase, f AS a, string_split(phrase, ' ') AS w
  FROM f WHERE n_words > 1 AND f >= {LEAST}),
inside AS (SELECT lang, phrase, max(a) AS longer FROM ({_inner_sql()}) GROUP BY ALL),
cuts AS ({_cuts_sql()}),
halves AS MATERIALIZED (
  SELECT cuts.*, f.f AS l FROM cuts JOIN f ON f.lang = cuts.lang AND f.phrase = cuts.first),
scored AS (
  SELECT halves.*, f.f AS r, CAST((CAST({SCALE} AS HUGEINT) * a) // (l + f.f) AS BIGINT) AS score
  FROM halves JOIN f ON f.lang = halves.lang AND f.phrase = halves.rest),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT best.lang, best.phrase, a, l, r, score,
    row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
  FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase
  WHERE longer IS NULL OR 100 * longer < {KEPT} * a)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM f WHERE n_words = 1 GROUP BY lang) t ON t.lang = ranked.lang
WHERE rank <= {TOP}
"""
