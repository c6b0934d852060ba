"""Languages of documents and passages: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import fold_word
from spindrift.plans.runtime import materialize

# Two-letter code, three-letter codes and English name of languages.
LANGUAGES = """
    ar ara arabic; bg bul bulgarian; bn ben bengali; ca cat catalan; cs ces cze czech; da dan danish; de deu ger german;
    el ell gre greek; en eng english; es spa spanish; et est estonian; fa fas per persian; fi fin finnish;
    fr fra fre french; he heb hebrew; hi hin hindi; hr hrv croatian; hu hun hungarian; id ind indonesian; it ita italian;
    ja jpn japanese; ko kor korean; lt lit lithuanian; lv lav latvian; ms msa malay; nl nld dut dutch; no nor norwegian;
    pl pol polish; pt por portuguese; ro ron rum romanian; ru rus russian; sk slk slo slovak; sl slv slovenian;
    sr srp serbian; sv swe swedish; sw swa swahili; ta tam tamil; th tha thai; tr tur turkish; uk ukr ukrainian;
    ur urd urdu; vi vie vietnamese; zh zho chi chinese
"""
NAMES = {name: names.split()[0] for names in LANGUAGES.split(";") for name in names.split()}
#: Bytes of a window; lines are cut into windows, every one of which is labelled.
WINDOW = 64
#: Bytes that one step of the network reads, each through a table of its own, and labels together.  Divides ``WINDOW``.
STRIDE = 4
_CODE = re.compile(r"\w\(|[;{}]\s*$|^\s*\$\s|&&|===?|=>")
#: Characters without one of which a line can't be code.
_CODE_MARK = re.compile("[(;{}$&=]")
_ALNUM = re.compile(r"[^\W_]")


def named_language(label: Column) -> Column:
    """Two-letter code of a label: a code of two or three letters, one with a region, or an English name, in any case; else null."""
    main = F.regexp_extract(fold_word(label), r"^([a-z]+)(?:[-_].*)?$", 1)
    table = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.try_element_at(table, main)


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): shaped like tanh, but a few machine instructions; its slope is (1 - |y|)^2."""
    return x / (1 + np.abs(x))


class ByteTagger:
    """Gated recurrent units in both directions over bytes, ``stride`` of them a step; a softmax labels every position."""

    def __init__(self, classes: list[str], hidden: int = 24, stride: int = STRIDE, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.classes, self.h, self.stride = classes, hidden, stride
        f = np.float32
        self.p = {
            "w": (rng.normal(0, 0.3, (2 * stride * 256, 3 * hidden))).astype(f),  # a row for each direction, place in the step and byte
            "u": (rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 3 * hidden))).astype(f),
            "v": (rng.normal(0, 1 / np.sqrt(2 * hidden), (2, hidden, len(classes)))).astype(f),
            "c": np.zeros(len(classes), f),
        }
        self.p["w"][::256] = 0  # byte 0 is padding

    def _inputs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``w`` (direction, batch, step, place), and the bytes of each step (step, batch)."""
        steps = x.reshape(len(x), -1, self.stride)
        at = steps.astype(np.int64) + 256 * np.arange(self.stride)
        return np.stack([at, at[:, ::-1] + 256 * self.stride]), (steps != 0).sum(axis=2).T

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Log probabilities (step, batch, classes) of ``x`` (batch, bytes; byte 0 pads the end); a step's are those of its positions."""
        n, h = len(x), self.h
        at, real = self._inputs(x)
        length = at.shape[2]
        mask = np.stack([real, real[::-1]], axis=1)[..., None] > 0
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((length, 2, n, h), np.float32)
        for t in range(length):
            g = self.p["w"][at[:, :, t]].sum(axis=2)
            u = state @ self.p["u"]
            rz = _soft(g[..., : 2 * h] + u[..., : 2 * h]) * np.float32(0.5) + np.float32(0.5)
            new = _soft(g[..., 2 * h :] + rz[..., :h] * u[..., 2 * h :])
            if keep is not None:
                keep.append((state, rz, new, u[..., 2 * h :]))
            state = (new + rz[..., h:] * (state - new)) * mask[t]
            states[t] = state
        if keep is not None:
            keep.append((at, mask, states, real))
        return self._labels(states)

    def _labels(self, states: np.ndarray) -> np.ndarray:
        logits = states[:, 0] @ self.p["v"][0] + states[::-1, 1] @ self.p["v"][1] + self.p["c"]
        logits -= logits.max(axis=-1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=-1, keepdims=True))
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients by backpropagation through time."""
        keep: list = []
        h, n = self.h, len(x)
        logp = self.forward(x, keep)
        at, mask, states, real = keep.pop()
        length, count = len(states), real.sum()
        loss = -float((logp[:, np.arange(n), y] * real).sum() / count)
        d = np.exp(logp)
        d[:, np.arange(n), y] -= 1
        d *= (real / count)[..., None]
        back = states[::-1, 1]
        grads = {"c": d.sum(axis=(0, 1)), "v": np.stack([np.einsum("tnh,tnk->hk", states[:, 0], d), np.einsum("tnh,tnk->hk", back, d)])}
        out = np.stack([d @ self.p["v"][0].T, (d @ self.p["v"][1].T)[::-1]], axis=1)
        du_sum, dg_all = np.zeros_like(self.p["u"]), np.empty((length, 2, n, 3 * h), np.float32)
        carry = np.zeros((2, n, h), np.float32)
        ut = self.p["u"].transpose(0, 2, 1)
        for t in reversed(range(length)):
            prev, rz, new, un = keep[t]
            r, z = rz[..., :h], rz[..., h:]
            ds = (out[t] + carry) * mask[t]
            dpre = ds * (1 - z) * (1 - np.abs(new)) ** 2
            dg = dg_all[t]
            dg[..., :h] = dpre * un * 2 * np.minimum(r, 1 - r) ** 2
            dg[..., h : 2 * h] = ds * (prev - new) * 2 * np.minimum(z, 1 - z) ** 2
            dg[..., 2 * h :] = dpre * r
            du_sum += prev.transpose(0, 2, 1) @ dg
            carry = ds * z + dg @ ut
            dg[..., 2 * h :] = dpre
        grads["u"] = du_sum
        dw, flat = np.zeros_like(self.p["w"]), dg_all.reshape(-1, 3 * h)
        for place in range(self.stride):
            rows = at[..., place].transpose(2, 0, 1).ravel()
            order = np.argsort(rows, kind="stable")
            first = np.flatnonzero(np.diff(rows[order], prepend=-1))
            dw[rows[order][first]] += np.add.reduceat(flat[order], first, axis=0)
        dw[::256] = 0
        grads["w"] = dw
        return loss, grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 256, rate: float = 0.01, seed: int = 2) -> float:
        """Adam over random batches; returns the mean loss of the last tenth of the steps.

        A window loses up to ``stride`` - 1 bytes at its start, so that words are seen at all places of a step.
        """
        rng = np.random.default_rng(seed)
        wide = np.pad(x, ((0, 0), (0, self.stride)))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            cut = rng.integers(0, self.stride, batch)
            loss, grads = self.gradients(wide[pick[:, None], cut[:, None] + np.arange(x.shape[1])], y[pick])
            losses.append(loss)
            norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
            scale = min(1.0, 1.0 / max(norm, 1e-9))
            lr = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                g = g * scale
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
        return float(np.mean(losses[-max(1, steps // 10) :]))

    def window_scores(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        """Sum over a window's positions of the log probabilities (windows, classes): ``forward`` without new arrays in its loop."""
        h, k, half = self.h, self.stride, np.float32(0.5)
        w, u = self.p["w"].astype(np.float32), self.p["u"].astype(np.float32)
        out = np.zeros((len(x), len(self.classes)), np.float32)
        gates, more, inner, spread = (np.zeros((2, batch, 3 * h), np.float32) for _ in range(4))
        before, fresh, spare = (np.empty((2, batch, h), np.float32) for _ in range(3))
        for i in range(0, len(x), batch):
            part = x[i : i + batch]
            n, length = len(part), max(1, -(-int((part != 0).sum(axis=1).max(initial=1)) // k))
            steps = part[:, : length * k].reshape(n, length, k)
            real = np.ascontiguousarray((steps != 0).sum(axis=2).T)
            full = (real > 0).all(axis=1)
            at = np.ascontiguousarray(steps.transpose(1, 2, 0)).astype(np.intp) + 256 * np.arange(k)[:, None]
            g, m, r, wide, s, new, size = gates[:, :n], more[:, :n], inner[:, :n], spread[:, :n], before[:, :n], fresh[:, :n], spare[:, :n]
            states = np.empty((length, 2, n, h), np.float32)
            s[:] = 0
            for t in range(length):
                for way, place in ((0, t), (1, length - 1 - t)):
                    np.take(w, at[place, 0] + way * k * 256, axis=0, out=g[way], mode="clip")
                    for j in range(1, k):
                        g[way] += np.take(w, at[place, j] + way * k * 256, axis=0, out=m[way], mode="clip")
                np.matmul(s, u, out=r)
                # All columns at once, as they lie in memory; the candidate's are not used.
                gate = np.add(g, r, out=m)
                np.abs(gate, out=wide)
                wide += 1
                gate /= wide
                gate *= half
                gate += half
                np.multiply(gate[..., :h], r[..., 2 * h :], out=new)
                new += g[..., 2 * h :]
                np.abs(new, out=size)
                size += 1
                new /= size
                s -= new
                s *= gate[..., h : 2 * h]
                s += new
                for way, place in ((0, t), (1, length - 1 - t)):
                    if not full[place]:
                        s[way] *= (real[place] > 0)[:, None]
                states[t] = s
            out[i : i + batch] = np.einsum("tnc,tn->nc", self._labels(states), real.astype(np.float32))
        return out


def fold(text: str) -> str:
    """Lower case, accents removed (the base letters stay)."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def windows_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all lines, and the line each belongs to; sorted by length so that batches need little padding."""
    raw = [" ".join(x.lower().split()).encode("utf-8", "replace").replace(b"\0", b" ") for x in lines]
    parts, owner = [], []
    for i, b in enumerate(raw):
        n = max(1, -(-len(b) // WINDOW))
        size = -(-len(b) // n)  # windows of a line are of equal size
        for k in range(0, len(b), max(1, size)):
            parts.append(b[k : k + size])
            owner.append(i)
    if not parts:
        return np.empty((0, WINDOW), np.uint8), np.empty(0, np.int64)
    order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
    flat = b"".join(parts[k].ljust(WINDOW, b"\0") for k in order)
    return np.frombuffer(flat, np.uint8).reshape(-1, WINDOW), np.array(owner, np.int64)[order]


def line_scores(model: ByteTagger, lines: list[str]) -> np.ndarray:
    """Mean log probability per position of each line and class (0 for a line without bytes); equal lines are read once."""
    place: dict[str, int] = {}
    of = [place.setdefault(x, len(place)) for x in lines]
    x, owner = windows_of(list(place))
    sums, n = np.zeros((len(place), len(model.classes))), np.zeros(len(place))
    if len(x):
        np.add.at(sums, owner, model.window_scores(x))
        np.add.at(n, owner, (x != 0).sum(axis=1))
    return (sums / np.maximum(n, 1)[:, None])[of]


def _text_lines(text: str) -> list[tuple[int, str, int]]:
    """(line_no, line, words) of the lines that hold words and aren't program code."""
    out = []
    for no, line in enumerate(text.split("\n"), 1):
        words = sum(map(bool, map(_ALNUM.search, line.split())))
        if words and not (_CODE_MARK.search(line) and _CODE.search(line)):
            out.append((no, line, words))
    return out


def backed_classes(evidence: np.ndarray, y: np.ndarray, counts: np.ndarray, least_backed: float = 0.05) -> np.ndarray:
    """Numbers of the classes that their own lines bear out, given each line's evidence (lines, classes) and the texts of each label.

    The sample has as many texts of a rare label as of a frequent one, so a label that only stands wrongly on texts of another
    language would share their evidence evenly.  Weighed by how many texts are labelled so, such lines go to the true
    language; lines of a language of its own stay, however rare it is.  The most frequent label is always kept.
    """
    weighed = evidence + np.log(np.maximum(counts, 1))
    rows = np.arange(len(y))
    own = weighed[rows, y]
    weighed[rows, y] = -np.inf
    backed = own >= weighed.max(axis=1) + _PRIOR
    return np.array([k for k in range(len(counts)) if k == counts.argmax() or (backed[y == k].mean() if (y == k).any() else 0.0) >= least_backed])


def train(rows: list[tuple[str, str]], steps: int = 400, hidden: int = 24, counts: dict[str, int] | None = None) -> ByteTagger:
    """A tagger from (text, code) rows whose labels are partly wrong; ``counts`` are the labelled texts of each language.

    Half of the windows also occur without accents.  After a first fit, classes that their lines don't bear out are
    dropped (``backed_classes``), and lines for which another language is more probable than the label are left out,
    which takes out wrong labels and foreign passages; a second fit follows.
    """
    classes = sorted({code for _, code in rows})
    lines, labels = [], []
    for text, code in rows:
        for _, line, words in _text_lines(text):
            if words >= 5:
                lines.append(line)
                labels.append(classes.index(code))
    model = ByteTagger(classes, hidden)
    if len(classes) < 2 or not lines:
        return model
    y = np.array(labels)
    keep = np.ones(len(lines), bool)
    for share, rate in ((0.4, 0.015), (0.6, 0.01)):
        own = [x if i % 3 else fold(x) for i, x in enumerate(lines) if keep[i]]
        x, owner = windows_of(own)
        model.fit(x, y[keep][owner], int(steps * share), rate=rate)
        scores = line_scores(model, lines)
        if counts and keep.all():
            size = np.array([len(x.encode("utf-8", "replace")) for x in lines])
            kept = backed_classes(scores * (size * _POSITIONS_A_BYTE)[:, None], y, np.array([counts[c] for c in classes]))
            if len(kept) < len(classes):
                model.classes = [classes[k] for k in kept]
                model.p["v"], model.p["c"] = model.p["v"][:, :, kept], model.p["c"][kept]
                stay = np.isin(y, kept)
                lines, y, scores = [x for x, ok in zip(lines, stay) if ok], np.searchsorted(kept, y[stay]), scores[stay][:, kept]
            counts = None
        keep = scores.argmax(axis=1) == y
    return model


def training_rows(documents: DataFrame, docs_a_language: int = 250) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """Labelled texts for the fit, about ``docs_a_language`` of each language that a label names, and the number of texts so labelled.

    The sample is bounded by this parameter and the table of languages, and drawn by the hash of the id; texts are whole.
    """
    labelled = documents.where("text <> '' and doc_id is not null").select("doc_id", "text", named_language(F.col("lang")).alias("code")).where("code is not null")
    counts = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row a known language
    if not counts:
        return [], counts
    size = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, n)])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.element_at(size, F.col("code"))) < docs_a_language)
    rows = chosen.orderBy("doc_id", "text").limit(2 * docs_a_language * len(counts)).collect()
    return [(r["text"], r["code"]) for r in rows], counts


#: A line is held foreign if its evidence, of so many independent positions a byte, outweighs the prior for the main language.
_POSITIONS_A_BYTE, _PRIOR = 0.2, 4.0


def _shares(evidence: np.ndarray) -> np.ndarray:
    p = np.exp(evidence - evidence.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _label(model_of):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: ByteTagger = model_of.value
        classes = np.array(model.classes, object)
        for whole in parts:
            for at in range(0, len(whole), 200):
                pdf = whole.iloc[at : at + 200]
                docs = [_text_lines(t) for t in pdf["text"]]
                lines = [x for d in docs for x in d]
                if not lines:
                    continue
                held = np.array([len(d) for d in docs])
                ids, n_lines = pdf["doc_id"].to_numpy()[held > 0], held[held > 0]
                first, of = np.cumsum(n_lines) - n_lines, np.repeat(np.arange(len(n_lines)), n_lines)
                words = np.array([x[2] for x in lines])
                size = np.array([len(x[1].encode("utf-8", "replace")) for x in lines])
                evidence = line_scores(model, [x[1] for x in lines]) * (size * _POSITIONS_A_BYTE)[:, None]
                p = _shares(evidence)
                by_doc, n_words = np.add.reduceat(p * words[:, None], first, axis=0), np.add.reduceat(words, first)
                main = by_doc.argmax(axis=1)
                evidence[np.arange(len(lines)), main[of]] += _PRIOR
                q = _shares(evidence)
                lang = q.argmax(axis=1)
                yield pd.DataFrame({
                    "doc_id": np.concatenate([ids, ids[of]]),
                    "line_no": np.concatenate([np.zeros(len(ids), np.int32), np.array([x[0] for x in lines], np.int32)]),
                    "lang": np.concatenate([classes[main], classes[lang]]),
                    "confidence": np.concatenate([by_doc[np.arange(len(ids)), main] / n_words, q[np.arange(len(lines)), lang]]),
                    "words": np.concatenate([n_words, words]),
                    "main": np.concatenate([np.ones(len(ids), bool), lang == main[of]]),
                })

    return run


def label_languages(documents: DataFrame, docs_a_language: int = 250, steps: int = 400) -> DataFrame:
    """doc_id, line_no, lang, confidence, words, main of each document (line 0) and each of its lines that holds words.

    The network is fitted on a bounded sample of labelled rows (``docs_a_language`` of each language) and labels every
    byte of every text; positions are pooled to lines, lines to documents by their words.  ``main`` says whether the
    language is the document's own.  Lines of program code have no row and don't count.

    Null or empty texts, texts without words and null ids give no row; if no row is labelled, or only one language
    is known, every text gets that one language or there is no row; repeated rows give repeated rows.
    """
    schema = "doc_id long, line_no int, lang string, confidence double, words int, main boolean"
    spark = documents.sparkSession
    rows, counts = training_rows(documents, docs_a_language)
    if not rows:
        return spark.createDataFrame([], schema)
    model = train(rows, steps, counts=counts)
    texts = documents.where("text <> '' and doc_id is not null").select("doc_id", "text")
    return texts.mapInPandas(_label(spark.sparkContext.broadcast(model)), schema)


def language_corrections(documents: DataFrame, least_words: int = 8, **options) -> DataFrame:
    """doc_id, line_no, lang: the main language where the label is missing or names another (line 0), and foreign lines."""
    found = materialize(label_languages(documents, **options).where(F.col("line_no").eqNullSafe(0) | (~F.col("main") & (F.col("words") >= least_words))), "languages")
    named = documents.where("doc_id is not null").select("doc_id", named_language(F.col("lang")).alias("_named"))
    whole = found.where("line_no = 0").join(named, "doc_id").where("_named is null or _named <> lang").select("doc_id", "line_no", "lang")
    return whole.unionByName(found.where("line_no > 0").select("doc_id", "line_no", "lang")).distinct()
