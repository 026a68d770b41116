"""Broken prompt and response pairs, and texts cut off by field limits, in stored descriptions of code.

Each description answers the request to describe its code. One pass over the table sorts every description by what it
is: without content, a giving-back of the code (compressed with the code as a zstandard dictionary), a refusal, another
language, or text. The ends of texts are then judged by the models of endings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from quillstone.llm import endings, languages
from quillstone.session import materialize

#: What stands for no content, in lower case and without surrounding punctuation.
PLACEHOLDERS = frozenset("none null nil n/a na n.a nan tbd tba todo undefined missing empty blank unknown placeholder void xxx nothing".split()) | {
    "no description", "not available", "not applicable", "no content", "no answer", "no text", "to be done", "to be added", "to do", "lorem ipsum",
    "insert description here", "description here", "no comment", "coming soon",
}
#: The refusal dictionary. Someone who speaks (or is spoken of), what they don't do, what they were to do.
_WHO = r"(?:i|we|i'm|we're|this (?:assistant|model)|the (?:assistant|model))"
_NOT = r"(?:can(?:no|')t|can not|could not|couldn't|will not|won't|would not|wouldn't|do not|don't|am not|are not|am unable|are unable|am afraid|prefer not|'m not|'m unable|unable|not able|not allowed|not permitted|refuse|decline)"
_DO = r"(?:describ\w*|explain\w*|explanation|answer\w*|comment\w*|help\w*|assist\w*|say|tell|summari[sz]e\w*|provid\w*|offer\w*|discuss\w*|respond\w*|reply|fulfil\w*|complete this|complete that|decline|refuse|generat\w*|interpret\w*|comply|do that|do this|continue|(?:access|see|open|process|read|share) (?:(?:the|this|that|your|any|such) )?(?:whole |full |actual )?(?:code|snippet|file|data|notebook|image|content|context|request|it|this|that)s?(?=\W*(?:$|[.,;!?]|here\b|yet\b|so\b|because\b|from\b)))"
REFUSALS = [
    re.compile(x, re.I)
    for x in (
        rf"(?:^|[.;,!?:]\s+|\b(?:but|and|that|time|afraid|assistant|model|moment|sorry|unfortunately|regrettably|apologies)\b[ ,]*){_WHO}\b[^.!?]{{0,40}}?\b{_NOT}\b[^.!?]{{0,60}}?\b{_DO}\b",
        r"\bas an? (?:ai\b|assistant|language model|artificial)",
        r"^(?:(?:i'm|i am|we're|we are) )?(?:very |so )?(?:sorry|apologies)\b(?:[,.;:!]| (?:but|i|we|that|this|to|for|no|not|as)\b)",
        r"^(?:unfortunately|regrettably)\b(?:,| (?:i|we|i'm|we're|this|that|it|there|no|not|the|your|my)\b)",
        r"\b(?:my|our) (?:guidelines|policy|policies|rules|instructions|programming)\b[^.!?]{0,60}\b(?:not|prevent|prohibit|forbid)\w*",
        r"\b(?:against|under|per|violates?) (?:my|our|the) (?:guidelines|policy|policies|rules|content policy)\b",
        r"\b(?:request|question|topic|this) (?:falls|lies|is) (?:outside|beyond)\b",
        r"\b(?:not|in)(?: be)? ?appropriate\b[^.!?]{0,30}\b(?:for me|for us|to (?:describe|explain|answer|comment))",
        r"\bno (?:description|explanation|answer|comment|summary) (?:can|could|will|may) be (?:offered|given|provided|made)",
        r"\b(?:please|kindly|could you|can you|would you)\b(?: \w+){0,2} (?:(?:provide|share|send)(?! the \w+ \w+ (?:by|in|with|as|from|to)\b)|give|rephrase|clarify|specify|upload|paste|post|tell|supply|consult|attach|show|ask|elaborate|try again|resubmit)\b",
        r"\b(?:what|which|how) (?:would|do|should) you (?:like|want|need|prefer|mean)\b",
        r"\b(?:i|we) (?:need|require|would need|'d need) (?:more|further|additional|the)\b[^.!?]{0,30}\b(?:information|context|details?|code|data|file)\b",
        r"\b(?:i|we) (?:must|have to|need to|would rather|'ll have to|will have to) (?:decline|refuse|pass)\b",
        r"\b(?:refuse|decline)s? to (?:describe|explain|answer|comment|say)\b",
    )
]
#: Words from which a text is scored for its language; least lead over English; descriptions in the sample of English.
LEAST_WORDS, LEAD, SAMPLE = 3, 0.05, 400
#: Greatest novelty of a copy; share of its runs of words that the code must have.
COPY, SHARED = 0.3, 0.6
#: Level of zstandard; sizes of its window and tables as powers of two for dictionaries up to 2^18 bytes, beyond which
#: they grow with the dictionary, so that all of it is searched.
LEVEL, WINDOW, TABLE = 3, 20, 17
_WORD = re.compile(r"\w+")
_INLINE = re.compile(r"`[^`]*`")
_ALNUM = re.compile(r"[^\W_]")
_LABEL = re.compile(r"^\W*(?:(?:here is|this is) the )?(?:answer|code|output|response|result|solution|python|snippet|description)\s*[:\n]", re.I)
#: What a frame of one match costs.
FRAME = 16
#: Letters and digits of the longest placeholder.
_LONGEST = max(sum(c.isalnum() for c in x) for x in PLACEHOLDERS)


@lru_cache(maxsize=32)
def _parameters(log: int) -> zstandard.ZstdCompressionParameters:
    grow = max(0, log - 18)
    return zstandard.ZstdCompressionParameters.from_level(
        LEVEL, window_log=min(31, WINDOW + grow), hash_log=min(30, TABLE + grow), chain_log=min(30, TABLE - 1 + grow), write_content_size=False, write_checksum=False, write_dict_id=False
    )


def is_empty(text: str | None) -> bool:
    """Null, or no letter or digit but a placeholder's."""
    if text is None:
        return True
    first = _ALNUM.search(text)
    if first is None:
        return True
    if next(islice(_ALNUM.finditer(text, first.start()), _LONGEST, None), None):
        return False  # more letters than any placeholder has
    last = len(text) - _ALNUM.search(text[::-1]).start()
    t = "".join(c for c in text[first.start() : last].lower() if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t")
    return re.sub(r"\s+", " ", t) in PLACEHOLDERS


class Copies:
    """Tells descriptions that give back their code, one code at a time."""

    def __init__(self, code: str | None):
        words = " ".join(_WORD.findall((code or "").lower()))
        self.words = f" {words} "
        self.compressor = None
        self.runs: dict[int, set[str]] = {}
        data = words.encode("utf-8", "surrogatepass").ljust(8)  # the least of a dictionary
        if words:
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.compressor = zstandard.ZstdCompressor(dict_data=d, compression_params=_parameters(len(data).bit_length()))

    def novelty(self, text: str) -> float:
        """Compressed size beyond one match per byte of the words: about 0 for a copy, a third and more for prose."""
        w = " ".join(_WORD.findall(_LABEL.sub("", text).lower()))
        if not w or self.compressor is None:
            return 1.0
        data = w.encode("utf-8", "surrogatepass")
        return max(0, len(self.compressor.compress(data)) - FRAME) / len(data)

    def runs_of(self, n: int) -> set[str]:
        """The runs of n words of the code, for long texts."""
        if n not in self.runs:
            w = self.words.split()
            self.runs[n] = {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
        return self.runs[n]

    def is_copy(self, text: str) -> bool:
        """Little novelty, and then exactly: most runs of three words are the code's, too."""
        w = _WORD.findall(_LABEL.sub("", text).lower())
        if len(w) < 2 or self.novelty(text) > COPY:
            return False
        n = min(3, len(w))
        runs = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
        if len(runs) > 50:
            shared = sum(x in self.runs_of(n) for x in runs)
        else:
            shared = sum(f" {x} " in self.words for x in runs)
        return shared >= SHARED * len(runs) and bool(len(w) > 3 or re.search(r"[=()\[\]{}.:_#]", text))


def is_refusal(text: str) -> bool:
    t = re.sub(r"`[^`]*`", "X", text).replace("’", "'")
    return any(p.search(t) for p in REFUSALS)


def _latin(c: str) -> bool:
    return c < "\u0250" or "\u1e00" <= c <= "\u1eff"


def is_foreign(text: str, profiles: languages.Profiles) -> bool:
    """Not English: by script, else by profile, and no more English than other words by dictionary; two words by the latter."""
    if not text.isascii():
        letters = [c for c in _INLINE.sub("", text) if c.isalpha()]
        if sum(_latin(c) for c in letters) * 2 < len(letters):
            return True  # another script, whether or not it has capitals and blanks between words
    w = [x for s in languages.sentences_of(text) or [text] for x in languages.words_of(s)]
    if len(w) < LEAST_WORDS:
        return len(w) > 1 and all(x in _OTHER for x in w)
    score = profiles.score(w)
    lead = score.max() - score[0]
    english, other = sum(x in _ENGLISH for x in w), sum(x in _OTHER for x in w)
    return lead > 0 and (other > english or lead >= LEAD and other == english)


_ENGLISH = frozenset(languages.FUNCTION_WORDS["en"].split())
_OTHER = frozenset(x for k, v in languages.FUNCTION_WORDS.items() if k != "en" for x in v.split()) - _ENGLISH


def english_sample(df: DataFrame, n: int = SAMPLE) -> list[tuple[str, str]]:
    """At most `n` descriptions, by hash: a bounded sample to fit the profile of English, which they are meant to be.

    Foreign ones among them are moved to their language by the fit.
    """
    h = F.xxhash64("rec_id", "t")
    few = df.select("rec_id", F.get("additional_descs.nl_desc.primary_desc", F.lit(0)).alias("t")).filter(F.col("t").isNotNull() & (F.length("t") < 5_000))
    return [("en", r.t) for r in few.orderBy(h).select("t").limit(n).collect()]


FEATURES = "rec_id long, desc_list string, pos long, field string, source string, kind string, state string, n_chars long, h long, blank boolean, ctx array<long>"
_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
LISTS = (("canonical", "primary_desc"), ("additional", "primary_desc"), ("additional", "context"))


def describe(df: DataFrame, lists: tuple[tuple[str, str], ...] = LISTS) -> DataFrame:
    """What every description is (FEATURES), in one pass over the table.

    kind: empty, copy, refusal, other_language or text; a context that is null or without content is `empty`, too. Null
    arrays have no descriptions; a null element or nl_desc is an empty description. Null codes can't be copied.
    """
    prototypes = languages.fit(english_sample(df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, contexts = languages.Profiles(prototypes), endings.Contexts()
        for b in batches:
            cols: list[list] = [[] for _ in range(11)]
            texts, where = [], []
            ids, codes, sources = (b.column(i).to_pylist() for i in range(3))
            arrays = [b.column(3 + i).to_pylist() for i in range(len(lists))]
            for r, (i, code, source) in enumerate(zip(ids, codes, sources)):
                copies = None
                for (name, field), a in zip(lists, arrays):
                    for pos, text in enumerate(a[r] or ()):
                        if is_empty(text):
                            kind = "empty"
                        else:
                            if copies is None:
                                copies = Copies(code)
                            if copies.is_copy(text):
                                kind = "copy"
                            elif field == "primary_desc" and is_refusal(text):
                                kind = "refusal"
                            elif field == "primary_desc" and is_foreign(text, profiles):
                                kind = "other_language"
                            else:
                                kind = "text"
                        state = endings.state_of(text) if kind not in ("empty", "copy") else None
                        if state == "none":
                            where.append(len(cols[0]))
                            texts.append(text)
                        blank = bool(text) and text[-1:].isspace()
                        for c, v in zip(cols, (i, name, pos, field, source, kind, state, len(text) if text else 0, endings.shape(text) if state else None, blank, None)):
                            c.append(v)
            for k, ctx in zip(where, endings.last_contexts(texts, contexts)):
                cols[10][k] = ctx
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=[x.split()[0] for x in FEATURES.split(", ")])

    column = {"canonical": "canonical_descs", "additional": "additional_descs"}
    picked = [F.col(f"{column[name]}.nl_desc.{field}").alias(f"a{i}") for i, (name, field) in enumerate(lists)]
    return df.select(F.col("rec_id").cast("long").alias("rec_id"), "code", "source", *picked).mapInArrow(run, FEATURES)


def judged(df: DataFrame, lists: tuple[tuple[str, str], ...] = LISTS) -> DataFrame:
    """FEATURES without ctx, each description once, and p_cut: the probability that it was cut.

    Every description has one posterior of the censoring of its source and its ending (endings.cut_probability). Of a
    description without content or giving back the code p_cut is null. Re-delivered records count once.
    """
    seen = materialize(describe(df, lists), "p1")
    key = ["rec_id", "desc_list", "pos", "field"]
    one = seen.dropDuplicates(key)
    ends = one.filter((F.col("state") == "none") & F.col("ctx").isNotNull()).select(*key, "ctx")
    column = {"canonical": "canonical_descs", "additional": "additional_descs"}
    texts = df.select(*[F.col(f"{column[name]}.nl_desc.{field}").alias(f"a{i}") for i, (name, field) in enumerate(lists)])
    p = endings.stop_probability(ends, texts, [f"a{i}" for i in range(len(lists))], key)
    # per list too: limits of storage may differ; the limit of a list's field is fitted on its own lengths
    content = one.filter(F.col("kind").isin("text", "refusal", "other_language")).withColumn("f", F.concat_ws("/", "desc_list", "field"))
    limit = endings.limits(content.select("source", F.col("f").alias("field"), "n_chars", "h")).withColumnRenamed("field", "f")
    joined = one.drop("ctx", "h").join(p, key, "left").withColumn("f", F.concat_ws("/", "desc_list", "field"))
    joined = materialize(joined, "p1j")
    whole = (F.col("state") == "stop").cast("double")
    # ends that look complete, with and without a stop, tell whether the source writes stops
    looks = F.when(F.col("state") == "stop", 1.0).when((F.col("state") == "none") & F.col("known") & (F.col("p_stop") > F.col("base")), 1.0).otherwise(0.0)
    rate = joined.filter(F.col("state").isNotNull()).groupBy("source").agg(((F.sum(whole * looks) + 1) / (F.sum(looks) + 2)).alias("stop_rate"))
    x = joined.join(rate.withColumnRenamed("source", "rs"), F.col("source").eqNullSafe(F.col("rs")), "left").drop("rs")
    x = x.join(limit.select(F.col("source").alias("ls"), F.col("f").alias("lf"), F.col("n_chars").alias("ln"), F.col("p_cut").alias("p_limit")), F.col("source").eqNullSafe(F.col("ls")) & (F.col("f") == F.col("lf")) & (F.col("n_chars") == F.col("ln")), "left")
    cut = endings.cut_probability(F.col("state"), F.coalesce("p_stop", F.lit(0.5)), F.coalesce("base", F.lit(0.5)), F.coalesce("known", F.lit(True)), F.coalesce("stop_rate", F.lit(0.5)), F.col("p_limit"), F.col("blank"))
    p_cut = F.when(F.col("state").isNotNull(), cut)
    return x.select(*key, "source", "kind", "state", "n_chars", "p_stop", "known", "p_limit", "stop_rate", p_cut.alias("p_cut"))


#: From which probability a text counts as cut.
CUT = 0.5


def defects(j: DataFrame) -> DataFrame:
    """(rec_id, desc_list, pos, defect) of the defective descriptions; each has one defect."""
    d = F.when(F.col("kind") != "text", F.col("kind")).when(F.col("p_cut") > CUT, F.lit("truncated"))
    return j.filter(F.col("field") == "primary_desc").select("rec_id", "desc_list", "pos", d.alias("defect")).filter(F.col("defect").isNotNull())


def cut_values(j: DataFrame) -> DataFrame:
    """The values of additional_descs that were cut: (rec_id, pos, field)."""
    return j.filter((F.col("desc_list") == "additional") & (F.col("p_cut") > CUT)).select("rec_id", "pos", "field")


def censoring(j: DataFrame) -> DataFrame:
    """The censoring posterior alone of every value of additional_descs with content: (rec_id, pos, field, n_chars, p_limit).

    p_limit is 0 where the length is no limit of the source.
    """
    v = j.filter((F.col("desc_list") == "additional") & F.col("p_cut").isNotNull())
    return v.select("rec_id", "pos", "field", "n_chars", F.coalesce("p_limit", F.lit(0.0)).alias("p_limit"))


def cut_rates(j: DataFrame) -> DataFrame:
    """Per source and field: values with content, cut ones and their rate, and the limits found."""
    v = j.filter((F.col("desc_list") == "additional") & F.col("p_cut").isNotNull())
    return v.groupBy("source", "field").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(F.col("p_cut") > CUT).alias("n_cut"),
        (F.count_if(F.col("p_cut") > CUT) / F.count(F.lit(1))).alias("cut_rate"),
        F.sort_array(F.collect_set(F.when(F.col("p_limit").isNotNull(), F.col("n_chars")))).alias("limits"),
    )
