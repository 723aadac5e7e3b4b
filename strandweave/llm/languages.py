"""Language of every text and of every passage in another language, with a confidence.

Method: a byte convolutional network written and trained in numpy. Bytes of a passage are
cut into windows of fixed length, embedded, convolved with filters of several widths,
max-pooled and classified by softmax; windows of a passage are averaged. It is trained at
query time on a bounded sample of labelled rows (``per_language`` texts of each label, by
a hash of the key, plus the small clean tables), in two rounds: the second leaves out
passages whose label the first contradicts, since labels are dirty.

Rows are not shuffled: each Arrow batch is made distinct, split into passages (sentences),
and unseen passages are classified in one batch. Network and labels are a few kilobytes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .charforms import LOOKALIKES, char_map

# Languages with their three-letter codes and English names.
LANGUAGES = {
    "de": ("deu", "ger", "german"), "en": ("eng", "english"), "es": ("spa", "spanish", "castilian"), "fr": ("fra", "fre", "french"),
    "it": ("ita", "italian"), "ja": ("jpn", "japanese"), "ko": ("kor", "korean"), "nl": ("nld", "dut", "dutch", "flemish"),
    "pl": ("pol", "polish"), "pt": ("por", "portuguese"), "ru": ("rus", "russian"), "tr": ("tur", "turkish"), "uk": ("ukr", "ukrainian"),
}
CODES = tuple(LANGUAGES)
NAMES = {name: code for code, names in LANGUAGES.items() for name in (code, *names)}

WINDOW = 64  # bytes of a window
SAMPLE_CHARS = 4_000  # characters of the longest text in the training sample
CLEAN_ROWS = 5_000  # rows of each clean table in the training sample
UNKNOWN = "und"  # a text whose language is none of the known ones
KEPT = 100_000  # passages a worker remembers; only speed depends on it
SURE = 0.55  # confidence a passage's language needs
OTHER_SURE = 0.80  # ... if it is not the language of most of the text

_NOISE = re.compile(r"https?://\S+|www\.\S+|\S+\s?@\s?[\w-]+\.\S+|[@#][\w.]+|\S+\s?[(\[]at[)\]]\s?\S+(?:\s?[(\[]dot[)\]]\s?\w+)*")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|(?<=[。！？])\s*|\s+//\s+|\s*[\r\n]+\s*|\s*[(\[](?=[^()\[\]]{12,}[)\]])|(?<=[^()\[\]]{12})[)\]]\s*|\s+[—|]\s+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_MIXED = re.compile("[Ѐ-ԯͰ-Ͽ！-ｚ﻿​-‏⁠͏­᠎ɑⱭ]")


def named_language(label: Column) -> Column:
    """The two-letter code of the language that a label names, else null."""
    plain = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    head = F.when(plain.rlike(r"^[a-z]{2,3}(?:[-_][a-z0-9]{2,8})*$"), F.regexp_extract(plain, r"^([a-z]{2,3})", 1)).otherwise(plain)
    return F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), head)


def _tables() -> tuple[dict[int, str], dict[int, str]]:
    to_cyrillic = {ord(latin): next(c for c in others if 0x400 <= ord(c) <= 0x52F) for latin, others in LOOKALIKES.items() if any(0x400 <= ord(c) <= 0x52F for c in others) and latin not in "sdhqwjlIJSDWQ"}
    to_cyrillic[ord("i")], to_cyrillic[ord("I")] = "і", "І"
    return char_map(), to_cyrillic


_FOLD, _CYRILLIC = _tables()
_KEEP_WIDE = {c: v for c, v in _FOLD.items() if not (0x400 <= c <= 0x52F or 0x370 <= c <= 0x3FF)}


def plain(text: str) -> str:
    """``text`` with look-alikes and width forms undone in the script of each word, so that it reads as its language."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFC", text)
    if not _MIXED.search(text):
        return text
    text = unicodedata.normalize("NFC", text.translate(_KEEP_WIDE))
    cyrillic = len(re.findall(r"[бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯїєґ]", text))
    if cyrillic * 4 >= len(re.findall(r"[A-Za-z]", text)) and cyrillic > 3:

        def word(m: re.Match) -> str:
            w = m.group()
            return w.translate(_CYRILLIC) if re.search(r"[Ѐ-ԯ]", w) else w

        return re.sub(r"\w+", word, text)
    return unicodedata.normalize("NFC", text.translate(_FOLD))


def _full(s: str) -> bool:
    """Whether a piece of text is long enough for a full sentence."""
    words = _WORDS.findall(s)
    return len(words) >= 3 and sum(map(len, words)) >= 10 or len(_CJK.findall(s)) >= 6


def passages(text: str) -> list[str]:
    """The full sentences of a text, cleaned of links, handles and tags."""
    out = []
    for s in _SPLIT.split(_NOISE.sub(" ", plain(text))):
        if s and _full(s):
            out.append(" ".join(s.split()))
    return out


def _windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, index of the text of each window)."""
    raw = [re.sub(r"[\d\W_]+", " ", t.lower()).strip().encode() for t in texts]
    n = [max(1, -(-len(b) // WINDOW)) for b in raw]
    out = np.zeros((sum(n), WINDOW), np.uint8)
    at = 0
    for b, k in zip(raw, n, strict=True):
        # the last window is moved back to be full, if the passage is long enough
        for i in range(k):
            a = min(i * WINDOW, max(0, len(b) - WINDOW))
            piece = b[a : a + WINDOW]
            out[at, : len(piece)] = np.frombuffer(piece, np.uint8)
            at += 1
    return out, np.repeat(np.arange(len(texts)), n)


class ByteNet:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, classes: int, embed: int = 8, filters: int = 28, widths: tuple[int, ...] = (2, 3, 4, 6), seed: int = 7):
        rng = np.random.default_rng(seed)
        self.widths, self.filters = widths, filters
        self.p = {"E": rng.normal(0, 0.3, (256, embed)).astype(np.float32), "O": rng.normal(0, 0.1, (filters * len(widths), classes)).astype(np.float32), "b": np.zeros(classes, np.float32)}
        self.p["E"][0] = 0
        for w in widths:
            self.p[f"W{w}"] = rng.normal(0, 1 / np.sqrt(w * embed), (w * embed, filters)).astype(np.float32)
            self.p[f"c{w}"] = np.zeros(filters, np.float32)

    def _pool(self, x: np.ndarray, train: bool):
        e = self.p["E"][x]
        n, length, d = e.shape
        pooled, kept = [], []
        for w in self.widths:
            view = np.lib.stride_tricks.as_strided(e, (n, length - w + 1, w * d), (e.strides[0], e.strides[1], e.strides[2]))
            a = (view.reshape(-1, w * d) @ self.p[f"W{w}"]).reshape(n, length - w + 1, self.filters)
            if train:
                # the maximum over a contiguous axis is several times faster
                at = np.ascontiguousarray(a.transpose(0, 2, 1)).argmax(axis=2)
                top = np.take_along_axis(a, at[:, None, :], 1)[:, 0]
                kept.append((view, at, top))
            else:
                top = a.max(axis=1)
            pooled.append(np.maximum(top + self.p[f"c{w}"], 0))
        return np.concatenate(pooled, 1), kept

    def probabilities(self, x: np.ndarray, chunk: int = 256) -> np.ndarray:
        out = np.empty((len(x), len(self.p["b"])), np.float32)
        for i in range(0, len(x), chunk):
            h, _ = self._pool(x[i : i + chunk], False)
            z = h @ self.p["O"] + self.p["b"]
            z = np.exp(z - z.max(1, keepdims=True))
            out[i : i + chunk] = z / z.sum(1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, batch: int = 128, rate: float = 6e-3, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                sel = order[i : i + batch]
                xb, yb, wb = x[sel], y[sel], weight[sel]
                h, kept = self._pool(xb, True)
                drop = (rng.random(h.shape) < 0.8).astype(np.float32) / 0.8
                hd = h * drop
                z = hd @ self.p["O"] + self.p["b"]
                z = np.exp(z - z.max(1, keepdims=True))
                g = z / z.sum(1, keepdims=True)
                g[np.arange(len(sel)), yb] -= 1
                g *= (wb / len(sel))[:, None]
                grad = {"O": hd.T @ g, "b": g.sum(0), "E": np.zeros_like(self.p["E"])}
                gh = (g @ self.p["O"].T) * drop * (h > 0)
                d = self.p["E"].shape[1]
                bytes_, backs = [], []
                for j, w in enumerate(self.widths):
                    view, at, _ = kept[j]
                    gj = gh[:, j * self.filters : (j + 1) * self.filters]
                    rows = view[np.arange(len(sel))[:, None], at]
                    grad[f"W{w}"] = np.einsum("nf,nfk->kf", gj, rows, optimize=True)
                    grad[f"c{w}"] = gj.sum(0)
                    back = gj[:, :, None] * self.p[f"W{w}"].T[None]
                    bytes_.append(xb[np.arange(len(sel))[:, None, None], at[:, :, None] + np.arange(w)].ravel())
                    backs.append(back.reshape(-1, d))
                seen, sums = np.concatenate(bytes_), np.concatenate(backs)
                grad["E"] = np.stack([np.bincount(seen, weights=sums[:, k], minlength=256) for k in range(d)], 1).astype(np.float32)
                grad["E"][0] = 0
                step += 1
                lr = rate * (1 - step / (total + 1))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v2[k] = 0.999 * v2[k] + 0.001 * grad[k] ** 2
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)


def _parted(net: ByteNet, text: str) -> list[str]:
    """A passage cut in two where its halves are surely in different languages (two sentences without a mark between)."""
    cuts = [m.start() for m in re.finditer(r"(?<=[^\W\d_,;:]) (?=[^\W\d_])", text)]
    cuts = [c for c in cuts if _full(text[:c]) and _full(text[c:]) and (not text[c + 1].islower() or (ord(text[c + 1]) > 0x36F) != (ord(text[c - 1]) > 0x36F))]
    if not cuts:
        return [text]
    p = classify(net, [x for c in cuts for x in (text[:c], text[c + 1 :])])
    best, where = 0.85, None
    for i, c in enumerate(cuts):
        a, b = p[2 * i], p[2 * i + 1]
        if a.argmax() != b.argmax() and min(a.max(), b.max()) > best:
            best, where = min(a.max(), b.max()), c
    return [text] if where is None else [text[:where], text[where + 1 :]]


def classify(net: ByteNet, texts: list[str]) -> np.ndarray:
    """Probabilities of each passage: the mean over its windows."""
    x, of = _windows(texts)
    p = net.probabilities(x)
    out = np.zeros((len(texts), p.shape[1]), np.float32)
    np.add.at(out, of, p)
    return out / np.bincount(of, minlength=len(texts))[:, None]


def train(labelled: list[tuple[str, str]], clean: list[tuple[str, str]], epochs: int = 6, seed: int = 5) -> ByteNet:
    """A network from dirty ``labelled`` and ``clean`` (text, code) pairs, in two rounds."""
    rng = np.random.default_rng(seed)
    texts, ys, trust = [], [], []
    seen: set[tuple[str, str]] = set()
    for pairs, w in ((sorted(labelled), 1.0), (sorted(clean), 1.5)):
        for t, code in pairs:
            for s in passages(t):
                if (s, code) not in seen:
                    seen.add((s, code))
                    texts.append(s)
                    ys.append(CODES.index(code))
                    trust.append(w)
    # accents are often left out in posts: each passage also counts without them
    bare = ["".join(c for c in unicodedata.normalize("NFD", t) if not 0x300 <= ord(c) < 0x370) if rng.random() < 0.3 else t for t in texts]
    y, w = np.array(ys), np.array(trust, np.float32)
    x, of = _windows(bare)
    share = np.bincount(y[of], minlength=len(CODES)).astype(np.float32)
    balance = np.sqrt(share.sum() / len(CODES) / np.maximum(share, 1)).clip(0.6, 4)
    net = ByteNet(len(CODES))
    net.fit(x, y[of], (w[of] * balance[y[of]]).astype(np.float32), max(1, epochs // 2))
    p = classify(net, texts)
    wrong = (p.argmax(1) != y) & (p[np.arange(len(y)), y] < 0.6 * p.max(1))
    keep = ~wrong[of]
    net = ByteNet(len(CODES))
    net.fit(x[keep], y[of][keep], (w[of] * balance[y[of]]).astype(np.float32)[keep], epochs)
    return net


def sample_labelled(rows: DataFrame, key: str, text: str, lang: str, per_language: int) -> list[tuple[str, str]]:
    """About ``per_language`` texts of each label (up to 2.5 times as many of a frequent one), chosen by a hash of the key.

    Texts of more than ``SAMPLE_CHARS`` characters are not in the sample; the others are whole.
    """
    named = rows.where(F.length(F.trim(F.col(text))).between(11, SAMPLE_CHARS)).select(F.col(key).alias("k"), F.col(text).alias("t"), named_language(F.col(lang)).alias("l")).where("l is not null")
    counts = {r[0]: r[1] for r in named.groupBy("l").count().collect()}
    if not counts:
        return []
    mean = sum(counts.values()) / len(counts)
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, min(1.0, per_language * min(2.5, max(1.0, (n / mean) ** 0.5)) / n))])
    draw = F.pmod(F.xxhash64("k"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    got = named.where(draw < F.element_at(share, F.col("l"))).select("t", "l").limit(2 * per_language * len(CODES)).collect()
    return [(r[0], r[1]) for r in got]


def fit_language_net(rows: DataFrame, clean: list[DataFrame], *, key: str, text: str, lang: str, per_language: int = 900) -> ByteNet:
    """The network of the module's description; ``per_language`` and ``CLEAN_ROWS`` bound the labelled sample."""
    held = [(r[0], r[1]) for c in clean for r in c.limit(CLEAN_ROWS).collect() if r[0] and r[1] in CODES]
    return train(sample_labelled(rows, key, text, lang, per_language), held)


def saved_net(spark: SparkSession, path: str, fit) -> ByteNet:
    """The network saved at ``path`` (a table of a few kilobytes); the first time ``fit`` makes it and it is saved."""
    net = ByteNet(len(CODES))
    try:
        got = {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
        if set(got) == set(net.p):
            net.p = {k: v.copy() for k, v in got.items()}
            return net
    except AnalysisException:
        pass
    net = fit()
    rows = [(k, list(v.shape), bytearray(np.ascontiguousarray(v, np.float32).tobytes())) for k, v in net.p.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)
    return net


# letters of the scripts that the known languages are written in
_WRITTEN = re.compile(r"[A-Za-zÀ-ɏḀ-ỿЀ-ԯ぀-ヿㇰ-ㇿ가-힣ᄀ-ᇿ]")
_LETTER = re.compile(r"[^\W\d_]")
_HAN = re.compile(r"[㐀-鿿]")


def known_script(text: str) -> bool:
    """Whether at least half of the letters are of scripts of the known languages; Han signs count only beside kana."""
    letters = len(_LETTER.findall(text))
    known = len(_WRITTEN.findall(text))
    if re.search(r"[぀-ヿ가-힣]", text):
        known += len(_HAN.findall(text))
    return letters > 0 and 2 * known >= letters


def judge(net: ByteNet, texts: list[str], known: dict[str, list[tuple[str, int, float]]]) -> list[list[tuple[str, str, float, bool]]]:
    """For each text its full sentences as (passage, code, confidence, whether it is sure).

    A passage in letters of no known language has the code ``UNKNOWN``; it is sure if no letter is of a known one.
    """
    split = [passages(t) for t in texts]
    new = list({s: None for p in split for s in p if s not in known})
    if new:
        if len(known) + len(new) > KEPT:
            known.clear()
            new = list({s: None for p in split for s in p})
        probs = classify(net, new)
        for s, i, c in zip(new, probs.argmax(1).tolist(), probs.max(1).tolist(), strict=True):
            parts = _parted(net, s) if c < 0.9 and len(s) > 40 else [s]
            if len(parts) == 2:
                p = classify(net, parts)
                known[s] = [(t, int(q.argmax()), float(q.max())) for t, q in zip(parts, p, strict=True)]
            else:
                known[s] = [(s, i, c)]
    out = []
    for p in split:
        got = [part for s in p for part in known[s]]
        mass: dict[int, float] = {}
        for s, i, c in got:
            mass[i] = mass.get(i, 0) + c * len(s.encode())
        main = max(mass, key=lambda i: (mass[i], -i), default=None)
        out.append([(s, CODES[i], c, c >= (SURE if i == main else OTHER_SURE)) if known_script(s) else (s, UNKNOWN, 1.0, True) for s, i, c in got])
    return out


def language_segments(rows: DataFrame, key: str, text: str, net: ByteNet) -> DataFrame:
    """(key, segment, lang, confidence, chars, full): every text as runs of sentences of one language, in order.

    ``full`` says that the segment has full sentences whose language is sure. Unsure sentences
    are there with their low confidence. A text without a full sentence is one segment, judged
    by all its letters; one without letters has ``UNKNOWN`` with confidence 0, and so have null
    and empty texts, with no characters. Letters of no known language give ``UNKNOWN`` with confidence 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[str, int, float]]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            enc = b.column(1).cast(pa.string()).dictionary_encode()
            texts = enc.dictionary.to_pylist()
            found = [_runs(x) for x in judge(net, texts, known)]
            short = [i for i, f in enumerate(found) if not f]
            bare = {i: " ".join(_NOISE.sub(" ", plain(texts[i])).split()) for i in short}
            lettered = [i for i in short if known_script(bare[i])]
            p = classify(net, [bare[i] for i in lettered]) if lettered else np.zeros((0, len(CODES)))
            guess = dict(zip(lettered, zip(p.argmax(1).tolist(), p.max(1).tolist(), strict=True), strict=True))
            for i in short:
                if i in guess:
                    found[i] = [(CODES[guess[i][0]], round(float(guess[i][1]), 4), len(bare[i]), False)]
                else:
                    found[i] = [(UNKNOWN, 1.0 if _LETTER.search(bare[i]) else 0.0, len(bare[i]), False)]
            out: list[tuple] = []
            for k, i in zip(b.column(0).to_pylist(), enc.indices.to_pylist(), strict=True):
                for at, segment in enumerate(found[i] if i is not None else [(UNKNOWN, 0.0, 0, False)]):
                    out.append((k, at, *segment))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [key, "segment", "lang", "confidence", "chars", "full"])

    return rows.select(key, text).mapInArrow(run, f"{key} bigint, segment int, lang string, confidence double, chars int, full boolean")


def _runs(sentences: list[tuple[str, str, float, bool]]) -> list[tuple[str, float, int, bool]]:
    """(code, confidence, characters, whether sure) of runs of sentences alike in language and sureness."""
    runs: list[tuple[str, bool, list[tuple[float, int]]]] = []
    for s, code, c, sure in sentences:
        if runs and runs[-1][:2] == (code, sure):
            runs[-1][2].append((c, len(s)))
        else:
            runs.append((code, sure, [(c, len(s))]))
    return [(code, round(float(sum(c * m for c, m in parts) / sum(m for _, m in parts)), 4), sum(m for _, m in parts), sure) for code, sure, parts in runs]


def unnamed_languages(rows: DataFrame, key: str, text: str, lang: str, net: ByteNet) -> DataFrame:
    """(key, true_lang): languages of full sentences that the label does not name, each once a row."""
    picked = rows.select(key, text, named_language(F.col(lang)).alias("named")).where(F.col(text).isNotNull() & (F.length(text) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[str, int, float]]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            enc = b.column(1).cast(pa.string()).dictionary_encode()
            langs = [sorted({code for _, code, _, sure in f if sure and code != UNKNOWN}) for f in judge(net, enc.dictionary.to_pylist(), known)]
            out = [(k, code) for k, i, named in zip(b.column(0).to_pylist(), enc.indices.to_pylist(), b.column(2).to_pylist(), strict=True) for code in langs[i] if code != named]
            cols = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], [key, "true_lang"])

    return picked.mapInArrow(run, f"{key} bigint, true_lang string")
