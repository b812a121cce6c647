"""Spelling variants of a vocabulary: words one edit apart, found by dynamic programming over sorted lists.

A pair of words one edit apart whose shorter word has L letters agrees in its first lo and its last L - hi letters if its
common prefix is at least lo and less than hi letters long. The vocabulary is dealt by such keys: with hi halfway, and with
lo halfway. Every pair has one key. A key of too many words has its range of places halved, so no list grows with the
vocabulary; the words of a range of one place differ there only, by one letter or two, so they are few at any size.

A task scans the sorted list of a key for each of its words. Rows of the edit matrix, three cells wide, are kept for the
prefix that a word shares with the one before it; where a row exceeds one edit, all words of that prefix are skipped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evengap.llm.common import stored
from evengap.llm.manifest import SQL_CRC, SQL_CRC_TABLE

LETTERS = "A-Za-zÀ-ÿ"
PIECE = 1_000_000
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: Words of a list above which it is dealt by finer keys.
LONGEST = 2_000
#: More than one edit.
FAR = 2


def pieces(text: str, other: re.Pattern) -> Iterator[str]:
    """The text in parts of about a million characters, never cut inside a run."""
    at = 0
    while len(text) - at > PIECE:
        found = other.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def lower(run: str) -> str:
    """A to Z in lower case, other letters as they are."""
    return run.lower() if run.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), run)


def vocabulary(docs: DataFrame, *, id: str = "doc_id", text: str = "text", letters: str = LETTERS, shortest: int = 6,
               fewest: int = 5, change: Callable[[str, str], str] | None = None) -> DataFrame:
    """(word, n): the lower-cased runs of at least `shortest` letters that occur at least `fewest` times in all texts.

    change(id, run), if given, replaces a document's runs before they are counted. Null texts have no runs, a null id is
    an empty text; repeated rows count again; other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")), F.col(text).cast("string")).where(F.col(text).isNotNull())

    def counted(batches):
        run, other = re.compile(f"[{letters}]{{{shortest},}}"), re.compile(f"[^{letters}]")
        total: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: Counter[str] = Counter()
                for piece in pieces(whole, other):
                    own.update(run.findall(piece))
                for word, n in own.items():
                    word = lower(word)
                    total[change(name, word) if change else word] += n
                if len(total) > HELD:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return (source.mapInArrow(counted, "word string, n long").where(F.length("word") >= shortest)
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest))


def scan(words: list[str]) -> Iterator[tuple[int, int, int]]:
    """(i, j, common prefix) of all pairs one edit apart in a sorted list of different words."""
    size = len(words)
    prefix = [0] * size
    for j in range(1, size):
        a, b = words[j - 1], words[j]
        n, end = 0, min(len(a), len(b))
        while n < end and a[n] == b[n]:
            n += 1
        prefix[j] = n
    for i, word in enumerate(words):
        length, padded = len(word), word + "\0\0"
        # rows[d]: edits from d letters of the other word to d - 1, d and d + 1 letters of this one; at first its own
        rows = [(FAR, 0, 1)] + [(1, 0, 1)] * length
        common = shared = length
        j = i + 1
        while j < size:
            shared, common = min(shared, prefix[j]), min(common, prefix[j])
            other = words[j]
            if abs(len(other) - length) > 1:
                j += 1
                continue
            del rows[shared + 1:]
            x, y, z = rows[-1]
            d = len(rows) - 1
            while d < len(other) and (x < FAR or y < FAR or z < FAR):
                c = other[d]
                left = min(y + 1, x + (padded[d - 1] != c))
                y = min(z + 1, left + 1, y + (padded[d] != c))
                z = min(y + 1, z + (padded[d + 1] != c))
                x = left
                rows.append((x, y, z))
                d += 1
            shared = d
            if x < FAR or y < FAR or z < FAR:
                if rows[-1][length - len(other) + 1] == 1:
                    yield i, j, common
                j += 1
            else:  # as far apart are all words of this prefix
                j += 1
                while j < size and prefix[j] >= d:
                    j += 1


def keyed(words: DataFrame) -> DataFrame:
    """With the key of (least, lo, hi): the first lo letters, and the last least - hi."""
    tail = F.greatest(F.col("least") - F.col("hi"), F.lit(0))
    return words.withColumn("key", F.xxhash64("least", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")),
                                              F.when(tail > 0, F.substring("word", -tail, tail))))


def ranges(*cuts) -> list:
    return [F.struct(a.cast("int").alias("lo"), b.cast("int").alias("hi")) for a, b in zip(cuts, cuts[1:])]


def lists(words: DataFrame, shortest: int, longest: int) -> DataFrame:
    """(key, least, lo, hi, word, n): the words of every list, none of more than `longest` words unless of one place."""
    length = F.length("word")
    roles = words.withColumn("least", F.explode(F.array(length, length - 1))).where(F.col("least") >= shortest)
    half = F.floor(F.col("least") / 2)
    rows = keyed(roles.withColumn("r", F.explode(F.array(*ranges(F.lit(0), half, F.col("least") + 1)))).select("word", "n", "least", "r.*"))
    rows, done = stored(rows, "lists"), None
    while True:
        large = rows.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > longest).select("key")
        large = stored(large, "large")
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        halves = (rows.join(large, "key", "left_semi").withColumn("r", F.explode(F.array(*ranges(F.col("lo"), middle, F.col("hi")))))
                  .select("word", "n", "least", "r.*"))
        rows = stored(keyed(halves), "lists")


def near(words: DataFrame, *, shortest: int = 1, longest: int = LONGEST) -> DataFrame:
    """(word, other, n): both ways, all pairs of different words that one inserted, deleted or replaced letter turns
    into each other, with the other's n. Words shorter than `shortest` letters are not looked at."""
    dealt = lists(words, shortest, longest).select("key", "word", "n", "least", "lo", "hi").repartition("key").sortWithinPartitions("key", "word")

    def met(rows: list[tuple]) -> Iterable[tuple[str, str, int]]:
        _, _, _, least, lo, hi = rows[0]
        words = [r[1] for r in rows]
        if all(len(w) > least for w in words):
            return
        for i, j, common in scan(words):
            if lo <= common < hi and min(len(words[i]), len(words[j])) == least:
                yield words[i], words[j], rows[j][2]
                yield words[j], words[i], rows[i][2]

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.string(), pa.int64()))], names=["word", "other", "n"])

    def scanned(batches):
        held: list[tuple] = []
        found: list[tuple[str, str, int]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    if len(held) > 1:
                        found.extend(met(held))
                    held = []
                    if len(found) > 20_000:
                        yield out(found)
                        found = []
                held.append(row)
        if len(held) > 1:
            found.extend(met(held))
        if found:
            yield out(found)

    return dealt.mapInArrow(scanned, "word string, other string, n long")


def variants(words: DataFrame, *, times: int = 5, shortest: int = 1, longest: int = LONGEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of (word, n); words have to be distinct.

    n_near: words one edit away. form: the one of largest n, ties to the smallest in code-point order, if its n is at least
    `times` the word's, else null. root: the last word that forms lead to. An n grows at each step, so there are no rings.
    """
    words = stored(words.select("word", "n"), "words")
    found = near(words, shortest=shortest, longest=longest).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "other")).alias("best"))
    formed = -F.col("best.m") >= times * F.col("n")
    rows = stored(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.other")).alias("form"),
        F.when(formed, -F.col("best.m")).alias("form_n")), "forms")
    ways = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # every round doubles the steps
        ways = stored(ways, "ways")
        next_ways = ways.select(F.col("word").alias("root"), F.col("root").alias("far"))
        if ways.join(next_ways, "root", "left_semi").isEmpty():
            break
        ways = ways.join(next_ways, "root", "left").select("word", F.coalesce("far", "root").alias("root"))
    return rows.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def slip(name: str, run: str) -> str:
    """The run without one letter where 199 divides its crc32 with the document's id, else as it is."""
    import zlib

    h = zlib.crc32(f"{name}:{run}".encode())
    if h % 199:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


SQL = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs),
hashed AS (
    SELECT run, n, {SQL_CRC.format("concat(doc_id::VARCHAR, ':', run)")} AS h FROM (
        SELECT doc_id, run, count(*) AS n FROM lowered WHERE length(run) >= 6 GROUP BY ALL), {SQL_CRC_TABLE}),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest FROM words, range(200) AS r(i) WHERE i < length(word)),
pairs AS (
    SELECT a.word, b.word AS other, b.n FROM cut AS a JOIN cut AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut AS a JOIN words AS b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut AS a JOIN words AS b ON a.rest = b.word),
best AS (
    SELECT word, n AS form_n, other AS form, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
    QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
forms AS (
    SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
           CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM words AS w LEFT JOIN best USING (word)),
ways AS (
    SELECT word, form AS far, 1 AS step FROM forms WHERE form IS NOT NULL
    UNION ALL SELECT w.word, f.form, step + 1 FROM ways AS w JOIN forms AS f ON w.far = f.word WHERE f.form IS NOT NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n
FROM forms LEFT JOIN (SELECT word, arg_max(far, step) AS root FROM ways GROUP BY word) USING (word)
"""
