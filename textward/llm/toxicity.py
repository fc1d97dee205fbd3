"""Toxicity of documents: a lexicon learned from labelled rows, found also where it is misspelled.

Learning. From a bounded sample of labelled rows (`sample_rows`; chosen by hash, copies and near copies counted once)
Spark counts, for each word and each stem (a word's first 4 to 7 letters), the toxic and the clean documents that hold
it, in two halves. Terms whose share of toxic documents is surely high, and not low in either half, make the lexicon, a
trie whose entries are words or stems; a stem must also begin two lexicon words. Words near a term that clean documents of the sample use are no misspellings.

Finding. A word's Levenshtein automaton runs down the trie: the automaton's state is, for each number of edits within
the bound, the set of the word's prefixes so near, as bits; a branch ends where no state is left. A word of 5 letters or more may differ by one
edit, one of 9 or more by two; stems are matched as they are. A worker keeps the distinct words it has met.

Scoring. Each hit looks at a window of words around it: quotation marks that enclose it, words of reporting, and words
that address somebody. A hit that is quoted, and reported or said to nobody, counts as quoted; others count as abuse, by their
term's share of toxic documents, a misspelled one as MISSPELLED of that for each edit. A logistic model of the counts of abuse, quoted and addressed hits is fitted on the
sample's rows, and on copies of its toxic rows in which the hits are misspelled (toxic) or quoted (clean), since the sample may hold few of
either; its output is the score.

Defined results: a null or empty text has no hits and takes the score of texts without hits; if there are no labels, or
only one class, the lexicon is empty and every score is the prior (0 without labels); a labelled id with several rows gives each of them its
label; repeated rows repeat; other columns stay as they are, but for one named score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.llm._shared import cut, kept, ship

WORD = re.compile(r"[^\W_]+")
STEMS = range(4, 8)
WINDOW = 6
#: Weight of a misspelled hit for each edit, against an exact one.
MISSPELLED = 0.9
#: Words of reporting and of address in the languages of the documents; fixed values.
REPORTS = frozenset("said says quote quoted quotes wrote writes reported reports called according cited term word phrase comment sagte schrieb zitat zitiert wort laut dit écrit cité citation mot selon dijo escribió citó cita palabra según".split())
ADDRESS = frozenset("you your youre u ur are du dich dir dein deine ihr euch bist seid tu te toi ton ta vous votre es êtes tú ti usted ustedes eres".split())
#: Quotation marks that open and close; straight ones do both.
OPEN, CLOSE = "“«‘„", "”»’“"


@dataclass
class Lexicon:
    """Terms and their weights, as a trie: nested dictionaries by character; key "" holds the kinds of entry that end there."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    #: words near a term that are no misspellings of it
    innocent: frozenset[str] = frozenset()

    def trie(self) -> dict:
        root: dict = {}
        for kind, terms in (("word", self.words), ("stem", self.stems)):
            for term in terms:
                at = root
                for c in term:
                    at = at.setdefault(c, {})
                at.setdefault("", {})[kind] = term
        return root


def edits(n: int) -> int:
    return 0 if n < 5 else 1 if n < 9 else 2


def match(trie: dict, word: str) -> tuple[str, str, int] | None:
    """The nearest entry within the word's bound: (kind, term, edits); ties go to the smaller kind and term."""
    has: dict[str, int] = {}
    for k, c in enumerate(word):
        has[c] = has.get(c, 0) | 1 << k
    whole, full = 1 << len(word), (2 << len(word)) - 1
    # with no edits first: few branches stay alive
    for most in range(edits(len(word)) + 1):
        # a state: for 0, 1, .. edits, the prefixes of the word that are within so many of the path, as bits by length
        found, todo = [], [(trie, tuple((2 << e) - 1 & full for e in range(most + 1)))]
        while todo:
            at, state = todo.pop()
            if ends := at.get(""):
                if "word" in ends and state[-1] & whole:
                    found.append(("word", ends["word"]))
                if "stem" in ends and state[0] and not most:
                    found.append(("stem", ends["stem"]))
            for c, below in at.items():
                if c and (after := _step(state, has.get(c, 0), full))[-1]:
                    todo.append((below, after))
        if found:
            return *min(found), most
    return None


def _step(state: tuple[int, ...], has: int, full: int) -> tuple[int, ...]:
    """The state one character of the path further, `has` being that character's places in the word."""
    less, after = state[0], (state[0] & has) << 1
    out = [after]
    for of in state[1:]:
        # the character stands in the word, or it is added or changed, or one of the word's is left out
        after = ((of & has) << 1 | less | less << 1 | after << 1) & full
        out.append(after)
        less = of
    return tuple(out)


class Finder:
    """One worker's lexicon, the words that it has met, and what they matched."""

    KEEP = 200_000

    def __init__(self, lexicon: Lexicon):
        self.trie, self.innocent, self.words, self.stems = lexicon.trie(), lexicon.innocent, lexicon.words, lexicon.stems
        self.met: set[str] = set()
        self.hits: dict[str, tuple[str, str, int]] = {}
        # a word within k edits of a term holds one of the term's k + 1 parts as it is; words without any part are not tried
        starts, ends, inner = set(lexicon.stems), set(), set()
        for term in lexicon.words:
            k = max(edits(len(term) + 2), edits(len(term)))
            cuts = [round(j * len(term) / (k + 1)) for j in range(k + 2)]
            parts = [term[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            starts.add(parts[0])
            ends.add(parts[-1])
            inner.update(parts[1:-1])
        # the parts in one automaton, those that begin or end a word with a space there
        self.maybe = ahocorasick.Automaton()
        for part in {f" {x}" for x in starts} | {f"{x} " for x in ends} | inner:
            self.maybe.add_word(part, None)
        self.maybe.make_automaton()

    def look(self, words: set[str]) -> set[str]:
        """Those of the words that match the lexicon."""
        if not len(self.maybe):
            return set()
        if len(self.met) > self.KEEP:
            self.met, self.hits = set(), {}
        new = words - self.met
        line, last = f" {' '.join(new)} ", 0
        for end, _ in self.maybe.iter(line):
            if end <= last:  # in the word tried last
                continue
            inside = end if line[end] != " " else end - 1
            begin, last = line.rindex(" ", 0, inside) + 1, line.index(" ", inside)
            word = line[begin:last]
            if word not in self.innocent and (m := match(self.trie, word)):
                self.hits[word] = m
        self.met |= words
        return words & self.hits.keys()

    def features(self, text: str | None) -> list[float]:
        """Abuse, quoted and addressed hits, as log(1 + count), and the share of words that are abuse."""
        low = (text or "").lower()
        words = WORD.findall(low)
        bad = self.look(set(words)) if words else ()
        if not bad:
            return [0.0] * 4
        spans = [m.span() for m in WORD.finditer(low)]
        abuse, quoted, addressed = 0.0, 0, 0
        for k, word in enumerate(words):
            if word not in bad:
                continue
            around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
            to_somebody, reported = not ADDRESS.isdisjoint(around), not REPORTS.isdisjoint(around)
            if _enclosed(low, spans, k) and (reported or not to_somebody):
                quoted += 1
            else:
                addressed += to_somebody
                kind, term, k = self.hits[word]
                abuse += (self.words if kind == "word" else self.stems)[term] * MISSPELLED**k
        return [math.log1p(abuse), math.log1p(quoted), math.log1p(addressed), abuse / len(words)]

    def variants(self, text: str) -> tuple[str, str] | None:
        """The text with its hits misspelled, and with its hits quoted; None without hits."""
        low = text.lower()
        bad = self.look(set(WORD.findall(low)))
        if not bad:
            return None
        drop = lambda w: w[:2] + w[3:] if edits(len(w) - 1) else w
        return tuple(WORD.sub(lambda m: to(m[0]) if m[0] in bad else m[0], low) for to in (drop, lambda w: f'the word "{w}"'))


def _enclosed(text: str, spans: list[tuple[int, int]], k: int) -> bool:
    """Whether a quotation mark opens before word k, within the window, and closes after it."""
    a, b = spans[k]
    before = text[spans[max(0, k - WINDOW)][0] - (spans[max(0, k - WINDOW)][0] > 0) : a]
    after = text[b : spans[min(len(spans) - 1, k + WINDOW)][1] + 1]
    if before.count('"') % 2 and '"' in after:
        return True
    # an apostrophe between letters is none
    if re.search(r"(?<![^\W_])'", before) and re.search(r"'(?![^\W_])", after):
        return True
    return any(before.rfind(c) > before.rfind(d) and d in after for c, d in zip(OPEN, CLOSE, strict=True))


def crc_fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4))


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]

    def score(self, features: list[float]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """text and toxic of at most about sample_rows labelled rows outside the held-out fold, chosen by a hash of the id."""
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_fold(F.col("doc_id")) != 2)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1e6 * sample_rows / n))
    # at most about sample_rows pairs of numbers
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")


def _counted(rows: DataFrame) -> DataFrame:
    """(term, kind, t0, t1, c0, c1): toxic and clean documents of the sample in two halves, copies and near copies counted once."""
    ship(rows.sparkSession)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, lists = [], []
            for text in batch.column(0).to_pylist():
                words = WORD.findall((text or "").lower())
                marks.append(min((xxhash.xxh3_64_intdigest(" ".join(words[k : k + 3])) >> 1 for k in range(max(1, len(words) - 2))), default=0))
                lists.append(sorted(set(words)))
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(lists, pa.list_(pa.string())), batch.column(1)], ["mark", "words", "toxic"])

    # documents that share their least 3-word hash are mostly copies: one of each mark and class counts; the mark also deals the halves
    once = rows.mapInArrow(terms, "mark long, words array<string>, toxic int").groupBy("mark", "toxic").agg(F.min(F.struct(F.size("words").alias("n"), "words")).alias("least"))
    once = once.select("least.words", (F.col("toxic") * 2 + F.pmod(F.xxhash64("mark"), F.lit(2))).cast("int").alias("cell"))
    names = ["c0", "c1", "t0", "t1"]  # by cell

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems = tuple(Counter() for _ in names), tuple(Counter() for _ in names)
        for batch in batches:
            for of, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[cell].update(of)
                stems[cell].update({w[:n] for w in of for n in STEMS if len(w) > n})
        for kind, cells in (("word", words), ("stem", stems)):
            keys = list(set().union(*cells))
            for a in range(0, len(keys), 100_000):
                part = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([kind] * len(part)), *(pa.array([c[k] for k in part], pa.int64()) for c in cells)], ["term", "kind", *names])

    return once.mapInArrow(count, "term string, kind string, " + ", ".join(f"{n} long" for n in names)).groupBy("term", "kind").agg(*(F.sum(n).alias(n) for n in names))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, least: int = 4) -> Model:
    """Fit the lexicon and the model on the sample. The driver gets counts, lexicon terms and sums over the sample alone: terms that at least `least` of
    its toxic rows have, all of them, so that `sample_rows` bounds them too."""
    rows = cut(sample(docs, labels, sample_rows), "toxic-sample")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model(Lexicon(), [30.0 if n.get(1) else -30.0, 0, 0, 0, 0])
    counts = cut(_counted(rows).withColumns({"t": F.col("t0") + F.col("t1"), "c": F.col("c0") + F.col("c1")}), "toxic-terms")
    # the lower end of the toxic documents' share, with a pseudo-document against each term; and the share in either half
    share = (F.col("t") - F.sqrt(F.col("t"))) / (F.col("t") + F.col("c") + 1)
    half = lambda k: F.col(f"t{k}") / (F.col(f"t{k}") + F.col(f"c{k}") + 1) >= 0.25
    good = counts.where((F.col("t") >= least) & (share >= 0.4)).withColumn("share", share).withColumn("both", half(0) & half(1)).orderBy(F.desc(share), "kind", "term").collect()
    words = {r.term: r.share for r in good if r.kind == "word"}
    begun = Counter(w[:k] for w in words for k in STEMS if len(w) >= k)
    stems: dict[str, float] = {}
    for r in sorted((r for r in good if r.kind == "stem"), key=lambda r: (len(r.term), r.term)):
        if r.both and r.t >= 3 * least and begun[r.term] >= 2 and not any(r.term.startswith(s) for s in stems):
            stems[r.term] = r.share
    sure = {r.term for r in good if r.both and r.t >= 2 * least}
    words = {w: share for w, share in words.items() if w in sure and not any(w.startswith(s) for s in stems)}
    lexicon = Lexicon(words, stems)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(lexicon)
        for batch in batches:
            found = [w for w in finder.look(set(batch.column(0).to_pylist())) if finder.hits[w][2]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["term"])

    # words within the bound of a term that clean documents use as often as toxic ones: at most a few for each term
    common = counts.where((F.col("kind") == "word") & (F.col("c") > 0) & (F.col("c") >= F.col("t"))).select("term")
    lexicon = Lexicon(words, stems, frozenset(r.term for r in common.mapInArrow(near, "term string").collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(lexicon)
        for batch in batches:
            x, y, w = [], [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(finder.features(text), toxic, 2)]
                if toxic and (v := finder.variants(text or "")):
                    rows += [(finder.features(v[0]), 1, 1), (finder.features(v[1]), 0, 1)]
                for to, values in zip((x, y, w), zip(*rows, strict=True), strict=True):
                    to += values
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(w, pa.int64())], ["x", "toxic", "n"])

    # rows with the same features are one row with a count; there are at most about three times sample_rows
    seen = rows.mapInArrow(run, "x array<double>, toxic int, n long").groupBy("x", "toxic").agg(F.sum("n").alias("n")).collect()
    return Model(lexicon, _fit(np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float), np.array([r.n for r in seen], float) / 2))


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[float]:
    """Newton steps of a ridge-penalised logistic regression, the intercept unpenalised."""
    x = np.hstack([np.ones((len(x), 1)), x])
    prior = np.array([0.0, 2.0, 0.0, 0.3, 0.0])
    w, ridge = prior.copy(), np.diag([1e-6, 0.5, 0.5, 0.5, 0.5])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (p - y)) + ridge @ (w - prior))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with a column score in place of any of that name."""
    ship(docs.sparkSession)
    given = docs.drop("score").withColumn("score", F.lit(0.0))
    at, names, mark = given.columns.index(text_col), given.columns, repr((sorted(model.lexicon.words.items()), sorted(model.lexicon.stems.items()), sorted(model.lexicon.innocent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, zero = kept("toxicity", mark, lambda: Finder(model.lexicon)), model.score([0.0] * 4)
        for batch in batches:
            got = [model.score(x) if any(x := finder.features(t)) else zero for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], names)

    return given.mapInArrow(run, given.schema)
