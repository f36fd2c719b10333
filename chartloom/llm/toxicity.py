"""Abusive, hateful and sexual language: maximum-scoring segments over token log-odds.

Texts become token sequences in which disguises are undone (letters as digits or signs,
letters kept apart by dots or blanks, letters starred out). Every token and pair of tokens
gets its log-odds between objectionable and other sentences under a Dirichlet prior that is
the corpus itself, in the categories it belongs to. What is learned comes from the labels
alone:

1. Labels are opinions on whole documents, so the first fit sets all sentences of documents
   labelled with a category against the corpus, and asks for support, for high odds and for
   next to no use in documents labelled clean.
2. A second fit sets the sentences in which the first finds a passage against the rest, over
   all documents, so that what stands beside a known word is learned too; what is in use in
   documents labelled clean is still left out.

In a category a feature scores no more than its log-odds against each other category.

All maximal scoring segments of a text are found in one linear pass. A segment's score S is
calibrated by the extreme-value law of maximal segments, E = K n exp(-rate S) for a text of n
tokens: the rate solves sum p(s) exp(rate s) = 1 over the token scores in documents labelled
clean, one unseen token at the highest score included, and K is its bound, the part of that
sum the positive scores make up. A passage counts if fewer than ``EXPECTED`` like it are expected, and a
document's score in a category is -ln E of its best passage.

Sentences are the unit of work: numbers are masked, and each task counts and scores a
sentence once however often it occurs, in tables that start again beyond ``SENTENCES``.

Bounds: at most ``LABELS`` labelled documents (the least by hash) train the first fit and the
calibration. A feature has to make up ``SHARE`` of its category's tokens, so fitted tables
stay below 2 / SHARE features a category whatever the size of the corpus. Counts and scores
cover all documents.

Defined results for odd input: null, empty and blank texts score 0 in every category; labels
outside the categories count as clean; a document with several labels trains each; repeated
rows each keep their row; without labels of a category nothing is known of it and nothing is
found; an empty table gives an empty table; extra columns are ignored; very long texts are
scanned whole.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.session import materialise, release

CATEGORIES = ["abusive", "hateful", "sexual"]
LABELS = 200_000
SENTENCES = 100_000  # distinct sentences a task holds at once
DRIFT = 1.2  # cost of a token that is no feature
PRIOR = 400.0  # size of the corpus prior in tokens
CAP = 6.0  # highest score of a token
LEAST = 0.5  # lowest score that makes a feature
SURE = 1.64  # standard errors taken off the log-odds
FIRST_ODDS, FIRST_LOW = 2.0, 1.0  # log-odds a feature of the first fit needs, plain and less ``SURE`` standard errors
SUPPORT = 2  # occurrences in objectionable sentences a feature needs
SHARE = 1e-5  # share of all tokens of these sentences a feature needs
CLEAN = 0.2  # occurrences in clean documents a feature may have for each one in documents labelled otherwise
PURITY = 0.7  # share of a feature's occurrences that must stand in passages, second fit
EXPECTED = 1e-3  # passages expected by chance in a document, below which one counts


def _fold(text: str) -> str:
    """Compatibility forms made plain and accents dropped."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


_LEET = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "!": "i", "€": "e", "|": "l"})
_ALIKE = str.maketrans("аеорсхіуѕјкмтнв", "aeopcxiysjkmthb")  # letters of another script that look Latin
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_SPACED = re.compile(r"(?<![\w@$])([\w@$])(?:([ .\-·])[\w@$](?![\w@$]))(?:\2[\w@$](?![\w@$]))+")
_TOKEN = re.compile(r"[^\W_][\w@$*€|']*[\w*@$~]|[@$][\w@$*]*[\w~]|[^\W_]|[.!?\n]")
_STOPS = {".", "!", "?", "\n"}
_CODE = re.compile(r"[a-z]{1,2}\d+|\d+[a-z]{1,3}")
_JOIN = re.compile(r"[ .\-·]")
# Both begin with what they consume and look back from there, so that they are tried at digits and blanks only.
_NUMBER = re.compile(r"\d(?<![\w@$*.\-]\d)[\d:.,/]*(?<=\d)(?![\w@$*])")
_SENTENCE = re.compile(r"\s(?:(?<=[.!?]\s)|(?<=[\r\n]))\s*")


def _joined(m: re.Match) -> str:
    """Letters kept apart put together and marked; plain numbers stay as they are."""
    word = _JOIN.sub("", m.group(0))
    return m.group(0) if sum(c.isalpha() for c in word) * 2 < len(word) else word + "~"


def tokens_of(text: str) -> list[str]:
    """Tokens with disguises undone; numbers become #, starred words keep their stars.

    A word put together from letters kept apart ends in ~ until the scorer has found its end.
    """
    text = _fold(_INVISIBLE.sub("", text).replace("’", "'").lower())
    if not text.isascii():
        text = re.sub(r"\w+", lambda m: m.group(0).translate(_ALIKE) if re.search(r"[a-z]", m.group(0)) else m.group(0), text)
    text = _SPACED.sub(_joined, text)
    out = []
    for t in _TOKEN.findall(text):
        if t.isalpha() or t in _STOPS:
            out.append(t)
        elif "*" in t or t[-1] == "~":
            out.append(t.translate(_LEET))
        elif "$" in t or "@" in t or (sum(c.isalpha() for c in t) * 5 >= len(t) * 2 and not _CODE.fullmatch(t)):
            out.append(t.translate(_LEET).strip("'"))
        else:
            out.append("#" if any(c.isdigit() for c in t) else t)
    return out


def sentences_of(text: str) -> list[str]:
    """Sentences and lines with plain numbers masked, so that those that differ in a number only are one."""
    return [x for x in _SENTENCE.split(_NUMBER.sub("0", text)) if x]


def _features(tokens: list[str]) -> Iterator[tuple[int, str]]:
    """(position, feature): tokens, and pairs of neighbours within a sentence."""
    before = ""
    for i, t in enumerate(tokens):
        if t in _STOPS:
            before = ""
            continue
        yield i, t
        if before:
            yield i, before + "_" + t
        before = t


class Scorer:
    """Features with their scores per category, the calibration, and the segment search."""

    def __init__(self, scores: dict[str, tuple[float, ...]], rates: tuple[float, ...] = (1.0,) * len(CATEGORIES), ks: tuple[float, ...] = (1.0,) * len(CATEGORIES)) -> None:
        self.scores, self.rates, self.ks = scores, rates, ks
        self.by_shape: dict[tuple[str, str, int], list[str]] = {}
        self.words = {w for f in scores for w in f.split("_") if len(w) >= 2}
        self.longest = max(map(len, self.words), default=0)
        for f in sorted(self.words):
            if len(f) >= 3:
                self.by_shape.setdefault((f[0], f[-1], len(f)), []).append(f)

    def _unmask(self, t: str) -> str:
        """A starred word as the feature it can stand for."""
        options = self.by_shape.get((t[0], t[-1], len(t)), [])
        fits = [o for o in options if all(x == "*" or x == y for x, y in zip(t, o))]
        return max(fits, key=lambda o: (max(self.scores.get(o, (0.0,))), o)) if fits else t

    def _divided(self, word: str) -> list[str]:
        """A run of letters as the fewest words of features, whole if that is impossible."""
        best: list[list[str] | None] = [[], *[None] * len(word)]
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - self.longest), j):
                if best[i] is not None and word[i:j] in self.words and (best[j] is None or len(best[i]) + 1 < len(best[j])):
                    best[j] = [*best[i], word[i:j]]
        return best[-1] or [word]

    def plain(self, tokens: list[str]) -> list[str]:
        """Starred words resolved; letters kept apart joined with what they belong to, before or after."""
        out: list[str] = []
        skip = False
        for i, t in enumerate(tokens):
            if skip:
                skip = False
            elif t[-1] == "~" and len(t) > 1:
                word = t[:-1]
                after = tokens[i + 1].rstrip("~") if i + 1 < len(tokens) and tokens[i + 1] not in _STOPS else ""
                if word in self.words:
                    out.append(word)
                elif after and word + after in self.words:
                    out.append(word + after)
                    skip = True
                elif out and out[-1] + word in self.words:
                    out[-1] += word
                elif after and after not in self.words and self._divided(word + after) != [word + after]:
                    out += self._divided(word + after)
                    skip = True
                elif len(word) > 1 and self._divided(word) == [word] and self._divided(word[1:]) != [word[1:]] or word[1:] in self.words:
                    out += [word[0], *self._divided(word[1:])]
                else:
                    out += self._divided(word)
            else:
                out.append(self._unmask(t) if "*" in t else t)
        return out

    def hits(self, tokens: list[str]) -> list[tuple[int, tuple[float, ...]]]:
        """(position, best scores of the features that end there) of plain tokens, where there are any."""
        at: dict[int, tuple[float, ...]] = {}
        for i, f in _features(tokens):
            s = self.scores.get(f)
            if s is not None:
                own = at.get(i)
                at[i] = s if own is None else tuple(map(max, own, s))
        return sorted(at.items())

    def best(self, hits: list[tuple[int, tuple[float, ...]]], c: int) -> list[tuple[float, int, int]]:
        """(raw score, start, stop) of the maximal scoring segments of a category."""
        items, last = [], -1
        for i, s in hits:
            if last >= 0 and i - last > 1:
                items.append((-DRIFT * (i - last - 1), last + 1, i))
            items.append((s[c], i, i + 1))
            last = i
        return maximal_segments(items)

    def worth(self, c: int, s: float, n: int) -> float:
        """-ln of the number of segments with a raw score of s expected in a text of n tokens."""
        return self.rates[c] * s - math.log(self.ks[c] * max(1, n))

    def segments(self, tokens: list[str]) -> list[tuple[int, float, float, int, int]]:
        """(category, calibrated score, raw score, start, stop) of significant passages of plain tokens.

        Passages of one category never overlap; those of different categories may, each is
        significant by itself.
        """
        hits = self.hits(tokens)
        found = [(c, self.worth(c, s, len(tokens)), s, a, b) for c in range(len(CATEGORIES)) for s, a, b in self.best(hits, c)] if hits else []
        return sorted((x for x in found if x[1] >= -math.log(EXPECTED)), key=lambda x: -x[2])


class Reader:
    """Texts to scored sentences; a sentence met before is not read again."""

    def __init__(self, scorer: Scorer) -> None:
        self.scorer = scorer
        self.known: dict[str, tuple[int, list]] = {}

    def sentence(self, text: str) -> tuple[int, list]:
        found = self.known.get(text)
        if found is None:
            if len(self.known) >= SENTENCES:
                self.known.clear()
            tokens = self.scorer.plain(tokens_of(text))
            found = self.known[text] = (len(tokens), self.scorer.hits(tokens))
        return found

    def joined(self, read: list[tuple[int, list]]) -> tuple[int, list]:
        """Number of tokens, and hits at their positions in the document, of its sentences."""
        n, hits = 0, []
        for size, own in read:
            hits += [(n + i, s) for i, s in own]
            n += size
        return n, hits

    def document(self, text: str) -> tuple[int, list]:
        return self.joined([self.sentence(x) for x in sentences_of(text)])

    def raw(self, text: str) -> tuple[int, list[float]]:
        """Number of tokens, and the raw score of the best segment of each category."""
        n, hits = self.document(text)
        return n, [max((s for s, _, _ in self.scorer.best(hits, c)), default=0.0) if hits else 0.0 for c in range(len(CATEGORIES))]


def maximal_segments(items: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments of (score, start, stop) items in linear time (Ruzzo and Tompa)."""
    stack: list[list[float]] = []  # left sum, right sum, start, stop
    total = 0.0
    for score, start, stop in items:
        before, total = total, total + score
        if score <= 0:
            continue
        new = [before, total, start, stop]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= new[0]:
                j -= 1
            if j < 0 or stack[j][1] >= new[1]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(r - left, int(a), int(b)) for left, r, a, b in stack]


_COUNTS = ["n_all", "n_bad", "n_clean", *(f"n_{c}" for c in CATEGORIES)]
_COUNT_TYPE = "feature string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
_COUNT_SCHEMA = pa.schema([("feature", pa.string()), *[(c, pa.int64()) for c in _COUNTS]])


def _emit(counted: dict[str, list[int]], plain) -> Iterator[pa.RecordBatch]:
    """Counts of sentences as counts of their features."""
    sums: dict[str, list[int]] = {}
    for sentence, times in counted.items():
        for f, k in Counter(f for _, f in _features(plain(tokens_of(sentence)))).items():
            own = sums.get(f)
            if own is None:
                sums[f] = [k * x for x in times]
            else:
                for j, x in enumerate(times):
                    own[j] += k * x
    keys = list(sums)
    for lo in range(0, len(keys), 20_000):
        part = keys[lo : lo + 20_000]
        yield pa.RecordBatch.from_pydict({"feature": part, **{c: [sums[f][j] for f in part] for j, c in enumerate(_COUNTS)}}, schema=_COUNT_SCHEMA)


def _summed(rows: DataFrame, count) -> DataFrame:
    return rows.mapInArrow(count, _COUNT_TYPE).groupBy("feature").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, kinds) of at most LABELS labelled documents, the least by hash: of a proven size."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.collect_set(F.lower("label")).alias("kinds"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELS)


def label_counts(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Occurrences of each feature: all, in documents labelled with a category, in clean ones, by category."""
    rows = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(known), "doc_id", "left").select("text", "kinds")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, list[int]] = {}
        for batch in batches:
            for text, kinds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [j for j, c in enumerate(CATEGORIES) if kinds and c in kinds]
                more = [0, 1, *[3 + j for j in own]] if own else [0, 2] if kinds else [0]
                for sentence in sentences_of(text):
                    times = counted.get(sentence)
                    if times is None:
                        times = counted[sentence] = [0] * len(_COUNTS)
                    for j in more:
                        times[j] += 1
            if len(counted) >= SENTENCES:
                yield from _emit(counted, _bare)
                counted = {}
        yield from _emit(counted, _bare)

    return _summed(rows, count)


def _bare(tokens: list[str]) -> list[str]:
    return [t.rstrip("~") if len(t) > 1 else t for t in tokens]


def passage_counts(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """Occurrences of each feature in sentences with a passage, and by the passage's category, over all documents."""
    shared = documents.sparkSession.sparkContext.broadcast((scorer.scores, scorer.rates, scorer.ks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Scorer(*shared.value))
        counted: dict[str, list[int]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                sentences = sentences_of(text)
                read = [reader.sentence(x) for x in sentences]
                n, hits = reader.joined(read)
                if not hits:
                    continue
                spans = [(c, a, b) for c in range(len(CATEGORIES)) for s, a, b in reader.scorer.best(hits, c) if reader.scorer.worth(c, s, n) >= -math.log(EXPECTED)]
                start = 0
                for sentence, (size, _) in zip(sentences, read):
                    found = {c for c, a, b in spans if a < start + size and b > start}
                    start += size
                    if found:
                        times = counted.setdefault(sentence, [0] * len(_COUNTS))
                        for j in (1, *[3 + c for c in found]):
                            times[j] += 1
            if len(counted) >= SENTENCES:
                yield from _emit(counted, reader.scorer.plain)
                counted = {}
        yield from _emit(counted, reader.scorer.plain)

    return _summed(documents.where("text IS NOT NULL").select("text"), count)


def _low_odds(y: float, n: float, z: float, m: float) -> float:
    """Log-odds of y in n against z in m, less ``SURE`` standard errors; half an occurrence more keeps an unseen z in bounds."""
    z += 0.5
    return math.log(y / max(n - y, 1e-9)) - math.log(z / max(m - z, 1e-9)) - SURE * math.sqrt(1 / y + 1 / z)


def fit(counts: DataFrame, totals: dict[str, int], first: bool) -> dict[str, tuple[float, ...]]:
    """Log-odds with Dirichlet priors of the features that speak for a category.

    ``counts`` has a feature's occurrences in all texts, in objectionable sentences and by
    category, and those in documents labelled clean or otherwise; ``totals`` their sums.
    """
    n_all, n_bad = max(1, totals["n_all"]), max(1, totals["n_bad"])
    enough = (F.col("n_bad") >= max(SUPPORT, math.ceil(SHARE * n_bad))) & (F.col("n_clean") <= CLEAN * F.col("n_labelled"))
    odds = F.log(F.col("n_bad") / n_bad) - F.log(F.greatest("n_all", "n_bad") / n_all)
    enough = enough & ((odds >= FIRST_ODDS) if first else (F.col("n_bad") >= PURITY * F.col("n_all")))
    by_kind = [max(1, totals[f"n_{c}"]) for c in CATEGORIES]
    scores: dict[str, tuple[float, ...]] = {}
    for r in counts.where(enough).toLocalIterator():
        alpha = PRIOR * r.n_all / n_all + 0.01
        low = _low_odds(r.n_bad + alpha, n_bad + PRIOR, max(0, r.n_all - r.n_bad) + alpha, max(1, n_all - n_bad) + PRIOR)
        if low <= (FIRST_LOW if first else LEAST):
            continue
        rate = [math.log((r[f"n_{c}"] + 0.5 * n / sum(by_kind)) / n) for c, n in zip(CATEGORIES, by_kind)]
        out = tuple(max(-DRIFT, min(CAP, low, own - max(x for j, x in enumerate(rate) if j != i))) for i, own in enumerate(rate))
        if max(out) > LEAST:
            scores[r.feature] = out
    return scores


def _sums(counts: DataFrame) -> dict[str, int]:
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS]).first().asDict()


_SEEN_TYPE = "kind int, value double, n bigint"
_SEEN = pa.schema([("kind", pa.int32()), ("value", pa.float64()), ("n", pa.int64())])


def calibrated(scores: dict[str, tuple[float, ...]], documents: DataFrame, known: DataFrame) -> Scorer:
    """The scorer with rate and K of every category, from documents labelled clean."""
    named = ", ".join(repr(c) for c in CATEGORIES)
    clean = known.where(f"NOT exists(kinds, k -> k IN ({named}))").select("doc_id")
    rows = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(clean), "doc_id", "left_semi").select("text")
    shared = documents.sparkSession.sparkContext.broadcast(scores)
    width = len(CATEGORIES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Scorer(shared.value))
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, hits = reader.document(text)
                for c in range(width):
                    for _, s in hits:
                        seen[c, round(s[c], 1)] += 1
                seen[width, -DRIFT] += n - len(hits)
        keys = list(seen)
        yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in keys], "value": [v for _, v in keys], "n": [seen[k] for k in keys]}, schema=_SEEN)

    mass: dict[int, Counter] = {}
    for r in rows.mapInArrow(count, _SEEN_TYPE).groupBy("kind", "value").agg(F.sum("n").alias("n")).collect():
        mass.setdefault(r.kind, Counter())[r.value] += r.n
    rates, ks = [], []
    for c in range(width):
        own = mass.get(c, Counter()) + mass.get(width, Counter()) + Counter({-DRIFT: 1, CAP: 1})
        rates.append(solved_rate(own))
        ks.append(sum(n * math.exp(rates[c] * s) for s, n in own.items() if s > 0) / sum(own.values()))
    return Scorer(scores, tuple(rates), tuple(ks))


def solved_rate(mass: Counter) -> float:
    """The positive solution of sum p(s) exp(rate s) = 1; needs a positive score and a negative mean."""
    total = sum(mass.values())
    excess = lambda rate: sum(n / total * math.exp(rate * s) for s, n in mass.items()) - 1
    if sum(n * s for s, n in mass.items()) >= 0:
        return 1e-6  # scores that favour passages in clean texts: nothing is significant
    lo, hi = 0.0, 1.0
    while excess(hi) < 0:
        lo, hi = hi, 2 * hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if excess(mid) > 0 else (mid, hi)
    return hi


def train(documents: DataFrame, labels: DataFrame) -> Scorer:
    known = materialise(labelled(labels), "labels")
    counts = materialise(label_counts(documents, known), "label-counts")
    totals = _sums(counts)
    first = calibrated(fit(counts.withColumn("n_labelled", F.col("n_bad")), totals, True), documents, known)
    use = counts.select("feature", "n_all", "n_clean", F.col("n_bad").alias("n_labelled"))
    found = materialise(passage_counts(documents, first).drop("n_all", "n_clean").join(use, "feature", "left").fillna(0), "passage-counts")
    second = calibrated(fit(found, _sums(found) | {"n_all": totals["n_all"]}, False), documents, known)
    for written in (found, counts, known):
        release(written)
    return second


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual): calibrated score of each document's best passage, 0 for none."""
    scorer = train(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast((scorer.scores, scorer.rates, scorer.ks))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Scorer(*shared.value))
        for batch in batches:
            best = []
            for text in batch.column(2).to_pylist():
                n, raw = reader.raw(text) if text else (0, [0.0] * len(CATEGORIES))
                worth = [reader.scorer.worth(c, s, n) if s > 0 else 0.0 for c, s in enumerate(raw)]
                best.append([x if x >= -math.log(EXPECTED) else 0.0 for x in worth])
            columns = {"doc_id": batch.column(0), "source": batch.column(1), **{c: pa.array([r[i] for r in best], pa.float64()) for i, c in enumerate(CATEGORIES)}}
            yield pa.RecordBatch.from_pydict(columns)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.mapInArrow(score, "doc_id bigint, source string, abusive double, hateful double, sexual double")


def flagged_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, category) of every document with a significant passage of the category."""
    kinds = F.explode(F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull()))
    return score_documents(documents, labels).select("doc_id", kinds.alias("category")).distinct()


def source_rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source: documents, and the share with each category."""
    scored = score_documents(documents, labels)
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *[F.round(F.avg((F.col(c) > 0).cast("double")), 6).alias(f"{c}_rate") for c in CATEGORIES])
