"""Spelling variants over a variable-length gram index.

Grams have ``SHORTEST`` to ``LONGEST`` code points. The dictionary is pruned by frequency: a gram is made longer only where it
occurs more often in the vocabulary than a limit, so rare grams stay short and frequent ones become selective. A word is
decomposed into one gram for each place: the longest of the dictionary that starts there.

One edit changes only the grams that cover its place (and, at a word's end, those that would have grown further). The largest
number of them over all places is the word's *bound*: two words one edit apart share all their other grams. Taking the
grams from rare to frequent, the first shared gram is among the first ``bound + 1`` of both words, so only the lists of
these grams are merged. A shared gram stands before the edit, and then all of the word up to it is the same, or after it, and
then all of the word from it on; lists are kept by gram, side and that text. Of the words in a list only those with nearly the same
letters and pairs of letters are candidates, which are verified character by character.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import python_workers, save

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
NOISE = 31
SHORTEST = 3
LONGEST = 4
# A gram that occurs more often is made longer; grows with the vocabulary so that the frequent grams of one length are at most FREQUENT.
LIMIT = 32
FREQUENT = 200_000
# Up to this length Spark's own edit distance verifies a pair; its time grows with the square of the length.
_SHORT = 40
_HELD = 1 << 17  # different words a task counts before it hands them on


def _run_pattern(least: int) -> re.Pattern:
    return re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")


def document_words(id: str, text: str, runs: re.Pattern, least: int, noise: int) -> Iterator[tuple[bytes, int]]:
    """Words of a document with their counts. Every ``noise``-th run (by a hash of id and run) loses one code point."""
    start = zlib.crc32(f"{id}:".encode())
    for run, n in Counter(runs.findall(text)).items():
        word = run.encode().lower()  # bytes: A-Z only
        h = zlib.crc32(word, start)
        if noise and h % noise == 0:
            letters = word.decode()
            at = h % len(letters)
            letters = letters[:at] + letters[at + 1 :]
            if len(letters) < least:
                continue
            word = letters.encode()
        yield word, n


def word_counts(docs: DataFrame, text: str = "text", id: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n) of all documents. Tasks hand on counts, so a frequent word is a few rows when it is shuffled."""
    python_workers(docs.sparkSession)

    def table(counts: Counter) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, counts = _run_pattern(least_length), Counter()
        for batch in batches:
            for key, value in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                for word, n in document_words(key, value.as_py(), runs, least_length, noise):
                    counts[word] += n
                if len(counts) > _HELD:
                    yield table(counts)
                    counts = Counter()
        if counts:
            yield table(counts)

    source = docs.select(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")
    counted = source.mapInArrow(of, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return save(counted.filter(F.col("n") >= least_count), "words")


# --- the gram index --------------------------------------------------------------------------------------------------------


def gram_dictionary(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, limit: int = LIMIT, frequent: int = FREQUENT) -> dict[str, int]:
    """The grams that occur more often than the limit, with their counts; all others are leaves of the dictionary.

    One pass for each length, over the grams whose prefix is frequent. At most ``frequent`` grams of a length can be.
    """
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    limit = max(limit, -(-places // frequent))
    known: dict[str, int] = {}
    for size in range(shortest, longest + 1):
        before = None if size == shortest else {gram for gram in known if len(gram) == size - 1}

        def of(batches: Iterator[pa.RecordBatch], size: int = size, before: set | None = before) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts: Counter = Counter()
                for word in batch.column("word").to_pylist():
                    grams = [word[k : k + size] for k in range(len(word) - size + 1)]
                    counts.update(grams if before is None else [g for g in grams if g[:-1] in before])
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["gram", "n"])

        found = words.select("word").mapInArrow(of, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        known |= {r["gram"]: r["n"] for r in found.filter(F.col("n") > limit).collect()}
    return known


def decomposed(word: str, known: dict[str, int], shortest: int, longest: int) -> list[str]:
    """The longest gram of the dictionary at every place."""
    out = []
    for at in range(len(word) - shortest + 1):
        size = shortest
        while size < longest and at + size < len(word) and word[at : at + size] in known:
            size += 1
        out.append(word[at : at + size])
    return out


def edit_bound(word: str, grams: list[str], known: dict[str, int], longest: int) -> int:
    """How many of a word's grams one edit can change."""
    steps = [0] * (len(word) + 1)
    growing = 0
    for at, gram in enumerate(grams):
        steps[at] += 1
        steps[at + len(gram)] -= 1
        growing += at + len(gram) == len(word) and len(gram) < longest and gram in known
    most = height = 0
    for step in steps:
        height += step
        most = max(most, height)
    return max(most, growing)


def list_keys(word: str, known: dict[str, int], shortest: int = SHORTEST, longest: int = LONGEST) -> set[int]:
    """The lists a word stands in, as hashes of the gram and the text between it and one end.

    If the rarest gram is shared, the edit can be on either side of it. A later gram is the first shared one only if the edit
    is in all grams before, which leaves few places for it, and none from some gram on.
    """
    grams, size, keys = decomposed(word, known, shortest, longest), len(word), set()
    low, high = -1, size
    order = sorted(range(len(grams)), key=lambda at: (known.get(grams[at], 0), grams[at], at))
    for at in order[: edit_bound(word, grams, known, longest) + 1]:
        end = at + len(grams[at])
        last = end if end == size and len(grams[at]) < longest and grams[at] in known else end - 1
        if high > last:
            keys.add(xxhash.xxh64_intdigest(f"{at}<{word[:end]}") - (1 << 63))
        if low < at:
            keys.add(xxhash.xxh64_intdigest(f"{end - at}>{word[at:]}") - (1 << 63))
        low, high = max(low, at), min(high, last)
        if low > high:
            break
    return keys


def signatures(word: str) -> tuple[int, int]:
    """Parities of the letters and of the pairs of neighbours, 64 classes each: one edit changes at most two and four."""
    letters = pairs = 0
    for code in map(ord, word):
        letters ^= 1 << (code & 63)
    for one, two in zip(word, word[1:], strict=False):
        pairs ^= 1 << ((ord(one) * 37 + ord(two)) & 63)
    return letters - (1 << 63), pairs - (1 << 63)


def one_edit(a: str, b: str) -> bool:
    """Whether two different words become equal by one inserted, deleted or replaced code point."""
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    at = len(commonprefix((a, b)))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _is_near(a: Column, b: Column) -> Column:
    # linear in the words' length
    @F.arrow_udf("boolean")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([one_edit(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    return of(a, b)


def near_words(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, limit: int = LIMIT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(a, an, b, bn): all pairs of words one edit apart with their counts, a before b."""
    if shortest + longest > least_length:
        raise ValueError("words have to be as long as the shortest and the longest gram together, or one edit could change all grams")
    known = gram_dictionary(words, shortest, longest, limit)
    shared = words.sparkSession.sparkContext.broadcast(known)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, keys, signs = [], [], []
            for k, word in enumerate(batch.column("word").to_pylist()):
                own = list_keys(word, shared.value, shortest, longest)
                owners += [k] * len(own)
                keys += own
                signs += [signatures(word)] * len(own)
            who = pa.array(owners, pa.int64())
            columns = [batch.column("word").take(who), batch.column("n").take(who), pa.array(keys, pa.int64())]
            columns += [pa.array([sign[k] for sign in signs], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "key", "letters", "pairs"])

    lists = words.mapInArrow(of, "word string, n bigint, key bigint, letters bigint, pairs bigint")
    lists = save(lists.withColumn("size", F.length("word")), "gram-lists")
    other = lists.select(*[F.col(c).alias(f"b_{c}") for c in lists.columns])
    alike = (F.abs(F.col("size") - F.col("b_size")) <= 1) & (F.bit_count(F.col("letters").bitwiseXOR(F.col("b_letters"))) <= 2)
    alike = alike & (F.bit_count(F.col("pairs").bitwiseXOR(F.col("b_pairs"))) <= 4) & (F.col("word") < F.col("b_word"))
    a, b, longer = F.col("word"), F.col("b_word"), F.greatest("size", "b_size")
    short = lists.filter(F.col("size") <= _SHORT).join(other.filter(F.col("b_size") <= _SHORT), (F.col("key") == F.col("b_key")) & alike)
    long = lists.filter(F.col("size") >= _SHORT).join(other.filter(F.col("b_size") >= _SHORT), (F.col("key") == F.col("b_key")) & alike & (longer > _SHORT))
    pairs = short.filter(F.levenshtein(a, b, 1) == 1).unionByName(long.filter(_is_near(a, b)))
    return save(pairs.select(F.col("word").alias("a"), F.col("n").alias("an"), F.col("b_word").alias("b"), F.col("b_n").alias("bn")).distinct(), "near-words")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word of each chain of forms. A form is at least ``RATIO`` times as frequent, so chains are short."""
    jump = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = jump.select(F.col("word").alias("w"), F.col("root").alias("next"))
        longer = save(jump.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        jump = longer.select("word", "root")
        if not longer.filter("moved").limit(1).count():
            return jump


def variants(words: DataFrame, ratio: int = RATIO, **grams: int) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` for every row of ``words`` (word, n; words are distinct)."""
    pairs = near_words(words, **grams)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("near_n")).union(pairs.select("b", "a", "an"))
    found = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = found.withColumnRenamed("word", "f_word")
    joined = words.join(found, F.col("word") == F.col("f_word"), "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    formed = save(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        ), "forms",
    )
    roots = _roots(formed.filter("form IS NOT NULL")).select(F.col("word").alias("r_word"), F.col("root").alias("r_root"))
    rooted = formed.join(roots, F.col("word") == F.col("r_word"), "left")
    return rooted.select("word", "n", "n_near", "form", "form_n", F.coalesce("r_root", "word").alias("root"))


def spelling_variants(
    docs: DataFrame, text: str = "text", id: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, noise: int = NOISE
) -> DataFrame:
    """:func:`variants` of the words of all documents.

    Words are runs of Latin letters, of which only A-Z are lower-cased. Null texts have no words; a null id counts as empty
    where runs are hashed; repeated rows count again; of near words with equal counts the first in code-point order is the
    form; words of any length are compared whole. An empty table, or one without frequent words, gives no rows.
    """
    return variants(word_counts(docs, text, id, least_length, least_count, noise), ratio, least_length=least_length)

