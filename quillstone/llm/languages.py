"""Language of documents and of segments by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram binds its letters' vectors, each permuted by its place
(rolled), by multiplication; a text bundles the vectors of its n-grams by addition. A language prototype is the bundle
of its training words; texts are compared with the centred prototypes by cosine. As the product with a prototype
distributes over a bundle, each word's products are worked out once and kept; the norm of a text's bundle follows from
its words' n-grams and counts, as random vectors of this size are all but orthogonal.

Prototypes are fitted on a bounded sample of labelled rows (SAMPLE per language) and on the function words below; wrong
labels in it are undone by assigning the sample's sentences anew before the last fit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

LANGS = ("en", "de", "fr", "es", "pt", "it", "nl", "ru")
#: Codes of these languages in two and three letters (both three-letter standards).
CODES = {
    "en": "en", "eng": "en", "de": "de", "deu": "de", "ger": "de", "fr": "fr", "fra": "fr", "fre": "fr", "es": "es", "spa": "es",
    "pt": "pt", "por": "pt", "it": "it", "ita": "it", "nl": "nl", "nld": "nl", "dut": "nl", "ru": "ru", "rus": "ru",
}
#: Frequent function words, the seed of each prototype.
FUNCTION_WORDS = {
    "en": "the of and a to in is that it for was with as are on be this by from at or an have not which but they their has when if will there all been can were only after before more than because",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über nur oder aber wenn weil vor man wurde",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux cette mais comme on tout nous sa fait été aussi leur bien peut ces y lorsque car être avant après",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha este sí porque esta entre cuando muy sin sobre ser también hasta hay donde quien desde todo nos durante antes",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já está eu também só pelo pela até isso ela entre depois sem mesmo aos foi são porque antes",
    "it": "di e il la che in un a per è una con non si da del le i al come dei nel più della gli alla sono anche ma lo se o delle su questo ha ci suo nella degli tra cui quando molto era dal senza prima dopo perché poi",
    "nl": "de van het een en in is dat op te zijn met voor niet die aan er om dan ook als maar bij uit of door nog naar heeft hij worden wordt tot ze werd over deze kan geen meer wat al hun moet was wel zo omdat voordat na we",
    "ru": "и в не на что с как по это из к у за от но для же то так все он она они мы вы был была были если или только когда до после при уже есть чтобы перед без потому может более также его их",
}

#: Size of the vectors, lengths of the n-grams, labelled rows per language in the sample, and rounds of relabelling.
DIM, GRAMS, SAMPLE, ROUNDS = 2048, (3, 4), 300, 2
#: Times that each function word counts beside the sample.
SEED_WEIGHT = 3
#: Words from which a worker forgets those it knows before the next text.
KEEP = 200_000

_FENCE = re.compile(r"(?:^|\n)[ \t]*(```|~~~).*?(?:\n[ \t]*\1[^\n]*|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`|https?://\S+|<[a-zA-Z/][^<>\n]*>")
_BRACKET = re.compile(r"\([^()\n]*\)|\[[^\[\]\n]*\]")
_END = re.compile(r"(?<=[.!?…。])[\"'”’»)\]]*\s+|\n\s*\n|\n(?!\s*(?:[/*#>]{1,3}\s*)?[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ])")
_WORD = re.compile(r"\w+(?:[.]\w+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_CODE_LINE = re.compile(r"^(?: {4,}|\t).*(?:[=(\[{}]|:\s*$)|^\s*(?:>>>|import \w+|from \w+ import|def \w+\(|return\b.*[\w)]$)|\w+\(.*\)\s*$|^\s*[\w.\[\]'\"]+\s*=\s*\S|^\s*(?:for|if|while) .*:\s*$", re.M)
_COMMENT = re.compile(r"//|#")


def label_of(lang: str | None) -> str | None:
    """The language that a label names, in any spelling; null if it names none of the eight."""
    return CODES.get(re.split(r"[-_]", lang.strip().lower())[0]) if lang else None


def sentences_of(text: str) -> list[str]:
    """The sentences of the prose in a text; code and bracketed remarks are left out."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\xad", "").replace("​", "")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    out = []
    lines = [x for x in text.split("\n") if not (x and _CODE_LINE.search(x))]
    for s in _END.split("\n".join(lines)):
        bare = _INLINE.sub(" ", s)
        if "(" in bare or "[" in bare:
            outside = _BRACKET.sub(" ", bare)
            if len(_LETTERS.findall(outside)) >= 2:
                bare = outside
            elif out and bare.lstrip().startswith(("(", "[")):
                continue  # a remark behind a sentence belongs to it
        if _LETTERS.search(bare):
            out.append(bare)
    return out


def words_of(sentence: str) -> list[str]:
    """Words that tell a language: letters only; no identifiers, numbers or names with inner capitals."""
    out = []
    for w in _WORD.findall(sentence):
        if "_" in w or "." in w and not w.replace(".", "").isalpha():
            continue
        if w.isalpha() and (w[1:].islower() or len(w) == 1 or w.isupper()):
            out.append(w.lower())
    return out


@lru_cache(maxsize=4096)
def _letter(c: str) -> np.ndarray:
    r = np.random.default_rng(zlib.crc32(c.encode("utf-8", "surrogatepass")))
    return r.integers(0, 2, DIM, dtype=np.int8) * 2 - 1


@lru_cache(maxsize=8192)
def _placed(c: str, shift: int) -> np.ndarray:
    return np.roll(_letter(c), shift)


def _bind(s: str) -> np.ndarray:
    gram = _placed(s[-1], 0)
    for k, c in enumerate(reversed(s[:-1]), 1):
        gram = gram * _placed(c, k)
    return gram


_bind_short = lru_cache(maxsize=8192)(_bind)


def word_vector(w: str) -> tuple[np.ndarray, int]:
    """The bundle of the n-grams of a word between blanks and of the whole word, and how many they are."""
    s = f" {w} "
    grams = Counter(s[i : i + n] for n in GRAMS if n < len(s) for i in range(len(s) - n + 1))
    total = _bind(s).astype(np.int32)
    for g, n in grams.items():
        total += _bind_short(g) if n == 1 else n * _bind_short(g).astype(np.int32)
    return total, 1 + sum(grams.values())


class Profiles:
    """Prototypes and the scores of words against them."""

    def __init__(self, prototypes: np.ndarray):
        p = prototypes - prototypes.mean(axis=0)
        self.prototypes = (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(LANGS) + 1), np.float32)

    def word(self, w: str) -> int:
        """The row of a word: its products with the prototypes and its number of n-grams."""
        got = self.place.get(w)
        if got is None:
            got = self.place[w] = len(self.place)
            if got >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            v, n = word_vector(w)
            self.rows[got, :-1] = self.prototypes @ v.astype(np.float32)
            self.rows[got, -1] = n
        return got

    def score(self, words: list[str]) -> np.ndarray:
        """Cosines of a text with the prototypes."""
        if not words:
            return np.zeros(len(LANGS), np.float32)
        if len(self.place) + len(words) > KEEP:
            self.place.clear()
        counts = Counter(words)
        places = [self.word(w) for w in counts]
        known = self.rows[places]
        n = np.fromiter(counts.values(), np.float32, len(counts))
        return n @ known[:, :-1] / np.sqrt(DIM * max(1.0, float(n * n @ known[:, -1])))

    def products(self, parts: list[list[str]]) -> np.ndarray:
        """The products of each text's bundle with the prototypes: cosines but for the norm, which is the same for all languages. No text is empty."""
        sizes = [len(w) for w in parts]
        if len(self.place) + sum(sizes) > KEEP:
            self.place.clear()
        word = self.word
        places = [word(w) for p in parts for w in p]
        return np.add.reduceat(self.rows[places, :-1], np.cumsum([0, *sizes[:-1]]))


def fit(sample: list[tuple[str, str]]) -> np.ndarray:
    """Prototypes (a row per language) from (label, text) rows and the function words."""
    seed = [Counter({w: SEED_WEIGHT for w in FUNCTION_WORDS[x].split()}) for x in LANGS]
    vectors: dict[str, np.ndarray] = {}

    def vector(w: str) -> np.ndarray:
        if w not in vectors:
            vectors[w] = word_vector(w)[0]
        return vectors[w]

    def prototypes(counts: list[Counter]) -> np.ndarray:
        out = np.zeros((len(LANGS), DIM), np.float64)
        for k, c in enumerate(counts):
            for w, n in c.items():
                out[k] += np.sqrt(n) * vector(w)
            out[k] /= max(np.linalg.norm(out[k]), 1e-9)
        return out

    parts = [(LANGS.index(x), words_of(s)) for x, t in sample for s in sentences_of(t)]
    given = [c.copy() for c in seed]
    for k, w in parts:
        given[k].update(w)
    now = prototypes(given)
    for _ in range(ROUNDS):
        p = Profiles(now)
        counts = [c.copy() for c in seed]
        for _, w in parts:
            if len(w) >= 3:
                counts[int(p.score(w).argmax())].update(w)
        now = prototypes(counts)
    return now


def labelled_sample(docs: DataFrame, text_col: str, label_col: str, id_col: str, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """At most `per_language` rows of each language label, chosen by hash; texts of up to 20,000 characters.

    A bound for fitting only: every text is scored whole. Two passes: one over the labels alone, for thresholds of the
    hashes, and one over the texts.
    """
    plain = F.lower(F.substring_index(F.translate(F.trim(F.col(label_col)), "_", "-"), "-", 1))
    code = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    # the smallest hashes per language: a threshold first, which leaves about twice as many rows as wanted
    n = {r.l: r.n for r in docs.select(code[plain].alias("l")).filter(F.col("l").isNotNull()).groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return []
    limit = {k: int(-(1 << 63) + 2.0 * per_language / v * ((1 << 64) - 1)) if v > 2 * per_language else (1 << 63) - 1 for k, v in n.items()}
    rows = docs.select(code[plain].alias("l"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("t"))
    rows = rows.filter(F.col("t").isNotNull() & (F.length("t") < 20_000) & (F.col("h") <= F.create_map(*[F.lit(x) for kv in limit.items() for x in kv])[F.col("l")]))
    few = rows.groupBy("l", "h").agg(F.min("t").alias("t"))
    few = few.withColumn("i", F.row_number().over(Window.partitionBy("l").orderBy("h"))).filter(F.col("i") <= per_language)
    return [(r.l, r.t) for r in few.orderBy("l", "h").select("l", "t").collect()]


def segments_of(labels: list[int], scores: np.ndarray) -> list[tuple[int, list[int]]]:
    """Runs of at least two sentences in one language: (language, places of sentences).

    A single sentence between is taken to its neighbours; a text without any run has one segment in the language of
    the highest total.
    """
    runs: list[tuple[int, list[int]]] = []
    for i, k in enumerate(labels):
        if runs and runs[-1][0] == k:
            runs[-1][1].append(i)
        else:
            runs.append((k, [i]))
    long = [r for r in runs if len(r[1]) > 1]
    if not long:
        return [(int(scores.sum(axis=0).argmax()), list(range(len(labels))))]
    out: list[tuple[int, list[int]]] = []
    for k, places in long:
        if out and out[-1][0] == k:
            out[-1][1].extend(places)
        else:
            out.append((k, list(places)))
    return out


#: A sentence of fewer words than this takes the language of the sentences before it (else behind it).
LEAST_WORDS = 4
SCHEMA = "doc_id long, label string, seg_no long, lang string, confidence double, n_sentences long, mixed boolean"


def analyse(text: str, profiles: Profiles) -> list[tuple[str, float, int]]:
    """The segments of a text: (language, confidence, sentences); none if the text has no words."""
    parts = [words_of(s) for s in sentences_of(text)]
    parts = [w for w in parts if w]
    if not parts:
        # nothing but code or identifiers: all its words decide
        w = [x.lower() for x in _LETTERS.findall(text)]
        parts = [w] if w else []
    if not parts:
        return []
    scores = profiles.products(parts)
    labels = scores.argmax(axis=1)
    if len(parts) > 1:
        sure = [i for i, w in enumerate(parts) if len(w) >= LEAST_WORDS]
        for i, w in enumerate(parts):
            if len(w) < LEAST_WORDS and sure:
                near = max((j for j in sure if j < i), default=None)
                labels[i] = labels[near if near is not None else min(sure)]
    out = []
    for k, places in segments_of(list(map(int, labels)), scores):
        mean = profiles.score([w for i in places for w in parts[i]])
        second = np.delete(mean, k).max()
        out.append((LANGS[k], float(max(0.0, min(1.0, (mean[k] - second) / max(abs(mean[k]), 1e-9)))), len(places)))
    return out


def identify(docs: DataFrame, prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Segments of every document with words (SCHEMA), in order of the text; `mixed` tells of more than one language.

    Null, empty and wordless texts give no row. Every text is scored whole, in one pass without a shuffle. Confidence
    is the margin of the best over the second cosine, from 0 to 1.
    """
    packed = prototypes.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(packed)
        for b in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for i, text, label in zip(*(c.to_pylist() for c in b.columns)):
                found = analyse(text, profiles) if text else []
                mixed = len({x for x, _, _ in found}) > 1
                for n, (lang, sure, size) in enumerate(found):
                    for c, v in zip(cols, (i, label_of(label), n, lang, sure, size, mixed)):
                        c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "label", "seg_no", "lang", "confidence", "n_sentences", "mixed"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), F.col(label_col).alias("l")).mapInArrow(run, SCHEMA)


def wrong_labels(found: DataFrame) -> DataFrame:
    """Rows of documents whose label is missing, names no or another language, or whose text is mixed."""
    return found.filter(F.col("mixed") | F.col("label").isNull() | (F.col("label") != F.col("lang")))
