"""Language of documents and of their stretches: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of a bounded sample of labelled documents on the executors; what comes back is one count per
language and hash bucket, whose number doesn't grow with the data, and becomes a matrix of log probabilities of fixed
size that is broadcast. A second round counts again under the labels the first round gives each sentence, which takes
wrong labels and mixed texts out of the counts. Scoring turns a batch of documents into one array of code points, hashes
all n-grams at once, looks their rows up and sums them for each sentence.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.boundaries import whole_text_ends
from textloom.llm.plain import blocks
from textloom.tables import cut_lineage

LANGUAGES = ("en", "es", "pt", "fr", "de", "ru", "zh", "ja")
#: Labelled documents the model is fitted on, at most about this many, whatever the size of the corpus.
TRAIN_ROWS = 6000
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: N-grams overlap, so their evidence is worth less than if they were independent.
EVIDENCE = 0.25

# Names and codes of the languages, in lower case.
NAMES = {
    "en": "en eng english anglais inglés inglês englisch английский 英语 英文 英語",
    "es": "es spa spanish castilian español espanol espagnol espanhol spanisch испанский 西班牙语 スペイン語",
    "pt": "pt por portuguese português portugues portugués portugais portugiesisch португальский 葡萄牙语 ポルトガル語",
    "fr": "fr fra fre french français francais francés francês französisch французский 法语 フランス語",
    "de": "de deu ger german deutsch alemán alemão allemand немецкий 德语 ドイツ語",
    "ru": "ru rus russian русский ruso russo russe russisch 俄语 ロシア語",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 chino chinês chinois chinesisch китайский 中国語",
    "ja": "ja jpn jp japanese 日本語 japonés japonês japonais japanisch японский 日语",
}
_CODES = {name: code for code, names in NAMES.items() for name in names.split()}


def language_code(label: Column) -> Column:
    """The code of the language a label names, whatever its case, region or length; null if it names none of them."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)", 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv]), F.nullif(first, F.lit("")))


def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    table = np.zeros(0x30000, dtype=np.uint32)
    for cp in range(min(0x30000, sys.maxunicode)):
        c = chr(cp)
        if c.isalpha() or 0x300 <= cp < 0x370:
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


_TABLE: list[np.ndarray] = []


def code_points(text: str) -> np.ndarray:
    """The lower-case letters of ``text``, anything else as 0."""
    if not _TABLE:
        _TABLE.append(_letters())
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return _TABLE[0][np.minimum(raw, 0x2FFFF)]


def gram_buckets(cps: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that begins at each code point; bucket 0 for what holds no letter."""
    out = []
    for n in ORDERS:
        h = np.full(len(cps), n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        some = np.zeros(len(cps), dtype=bool)
        for j in range(n):
            c = cps if j == 0 else np.concatenate([cps[j:], np.zeros(min(j, len(cps)), dtype=np.uint32)])
            h = (h ^ c) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            some |= c > 0
        out.append(np.where(some, h % np.uint32(BUCKETS - 1) + 1, 0).astype(np.int32))
    return out


def sentences(text: str | None) -> list[str]:
    """The sentences of a document's words."""
    out: list[str] = []
    for block in blocks(text):
        begin = 0
        for e in whole_text_ends(block):
            out.append(block[begin:e])
            begin = e
    return out


def score_sentences(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Sums of log probabilities, one row for each text and a column for each language."""
    result = np.zeros((len(texts), len(LANGUAGES)), dtype=np.float32)
    at = 0
    while at < len(texts):  # about a million code points at a time
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < 1_000_000):
            size += len(texts[end]) + 2
            end += 1
        # Two breaks before each text keep its n-grams from reaching into the next.
        cps = code_points("".join(["\n\n" + t for t in texts[at:end]]))
        starts = np.cumsum([0] + [len(t) + 2 for t in texts[at : end - 1]])
        total = None
        for b in gram_buckets(cps):
            rows = model[b]
            total = rows if total is None else np.add(total, rows, out=total)
        result[at:end] = np.add.reduceat(total, starts, axis=0)
        at = end
    return result


def _fold(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _counts(batches: Iterator[pd.DataFrame], model: np.ndarray | None) -> Iterator[pd.DataFrame]:
    counts = np.zeros((len(LANGUAGES), BUCKETS), dtype=np.int64)
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.iloc[lo : lo + 256]
            units = [sentences(t) for t in part["text"]]
            flat = [u for d in units for u in d]
            if not flat:
                continue
            if model is None:
                labels = np.repeat([LANGUAGES.index(c) for c in part["code"]], [len(d) for d in units])
            else:
                labels = score_sentences(flat, model).argmax(axis=1)
            for k in np.unique(labels):
                own = "".join("\n\n" + u for u, x in zip(flat, labels, strict=True) if x == k)
                # Also as it looks without its diacritics: some documents are written so.
                for variant in (own, _fold(own)) if LANGUAGES[k] in ("es", "pt", "fr", "de") else (own,):
                    for b in gram_buckets(code_points(variant)):
                        counts[k] += np.bincount(b, minlength=BUCKETS)
    counts[:, 0] = 0
    k, b = np.nonzero(counts)
    yield pd.DataFrame({"k": k.astype(np.int32), "b": b.astype(np.int32), "n": counts[k, b]})


def fit(df: DataFrame, text: str, label: str, key: str, train_rows: int = TRAIN_ROWS, rounds: int = 2) -> np.ndarray:
    """The matrix of log probabilities, ``BUCKETS`` x languages, from about ``train_rows`` labelled rows of ``df``.

    Rows are taken by the hash of their key. A language without any labelled row keeps a flat distribution.
    """
    labelled = df.select(F.col(text).alias("text"), language_code(F.col(label)).alias("code"), F.xxhash64(F.col(key)).alias("h")).where(F.col("code").isNotNull() & F.col("text").isNotNull())
    n = df.count()
    share = min(1.0, train_rows / max(1, n))
    sample = labelled.where(F.pmod("h", F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("text", "code")
    sample = cut_lineage(sample) if rounds > 1 else sample
    model = None
    for _ in range(rounds):
        given = model
        rows = sample.mapInPandas(lambda it, m=given: _counts(it, m), "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((BUCKETS, len(LANGUAGES)), 0.0)
        counts[rows["b"].to_numpy(int), rows["k"].to_numpy(int)] = rows["n"].to_numpy(float)
        counts += 0.5
        model = np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)
        model -= model.mean(axis=1, keepdims=True)
        model[0] = 0.0
    return model


_WORDS = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?…。！？｡][\s)\]）】》〉’'”»」』\"“]*\Z")


def _whole(sentence: str) -> bool:
    """Whether a text is a whole sentence rather than a name or a fragment of a few words without an end mark."""
    if len(sentence) >= 60:
        return True
    letters = sum(map(len, _WORDS.findall(sentence)))
    wide = any("\u3040" <= c <= "\u9fff" for c in sentence)
    return letters >= (4 if wide else 12) and (letters >= (6 if wide else 24) or _END.search(sentence) is not None)


def stretches(docs: list[list[str]], scores: np.ndarray) -> list[list[tuple[str, float, int]]]:
    """``(language, confidence, sentences)`` of each run of sentences in one language, for each document.

    ``scores`` has a row for each sentence of all documents. What is no whole sentence goes with the sentence before it.
    """
    out: list[list[tuple[str, float, int]]] = []
    if not len(scores):
        return [[] for _ in docs]
    best = scores.argmax(axis=1)
    two = np.partition(scores, -2, axis=1)
    clear = (two[:, -1] - two[:, -2]) >= 2.0
    sums = np.vstack([np.zeros((1, len(LANGUAGES))), np.cumsum(scores, axis=0, dtype=np.float64)])
    at = 0
    for units in docs:
        n = len(units)
        lo, hi, at = at, at + n, at + n
        firm = [int(k) if c and _whole(u) else None for u, k, c in zip(units, best[lo:hi], clear[lo:hi], strict=True)]
        last = next((k for k in firm if k is not None), None)
        if last is None:
            if not any(_WORDS.search(u) for u in units):
                out.append([])
                continue
            last = int((sums[hi] - sums[lo]).argmax())
        starts: list[tuple[int, int]] = []
        for i, k in enumerate(firm):
            if i == 0 or k is not None and k != last:
                last = last if k is None else k
                starts.append((lo + i, last))
        runs = []
        for (b, k), e in zip(starts, [x for x, _ in starts[1:]] + [hi], strict=True):
            s = sums[e] - sums[b]
            p = np.exp(EVIDENCE * (s - s.max()))
            runs.append((LANGUAGES[k], float(np.round(p[k] / p.sum(), 6)), e - b))
        out.append(runs)
    return out


_SCHEMA = "doc_id long, label string, segment_no long, segments int, lang string, confidence double, sentences int"


def language_segments(df: DataFrame, key: str, text: str, label: str, model: np.ndarray) -> DataFrame:
    """One row for each stretch of each document in one language, as :data:`_SCHEMA`, numbered from 1 in order.

    ``label`` is kept as it is. Null, empty and wordless texts have no stretch, nor have rows without a key. Ties go to the language that
    :data:`LANGUAGES` names first. Whole texts are read; a document is one row of one task.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.iloc[lo : lo + 512]
                per_doc = [sentences(t) for t in part["text"]]
                scores = score_sentences([u for d in per_doc for u in d], shared.value)
                rows = [(k, lab, i, len(own), lang, conf, n) for k, lab, own in zip(part["key"], part["label"], stretches(per_doc, scores), strict=True) for i, (lang, conf, n) in enumerate(own, 1)]
                yield pd.DataFrame(rows, columns=names)

    return df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).mapInPandas(run, _SCHEMA)


def fit_and_segment(df: DataFrame, key: str, text: str, label: str) -> DataFrame:
    return language_segments(df, key, text, label, fit(df, text, label, key))
