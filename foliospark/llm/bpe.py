"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, one after the other, into a deterministic automaton over tokens: a merge of u and v to w
is a gadget that redirects the arcs labelled u to a copy of their target that has lost its arc v, and adds arcs
labelled w to where u and then v led. The automaton accepts exactly one token path for every string: the one that
applying the merges in order gives. All arcs with one label lead to one state, so a state is stored per token, and
an arc's presence follows from the arcs its target state has lost; looked-up arcs are kept in a transition table.

Encoding follows the arcs of the table over the characters of a pre-split word; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .encoding import _ODD, byte_letters, load, vocabulary

#: Chunks and words held per worker. A full memo becomes the old one, from which what is used comes back; so size costs
#: time only.
MEMO_SIZE = 300_000
#: Chunks of a text that are looked up together; fewer than a memo holds.
RUN = 20_000
#: Looked-up arcs held per worker.
ARCS = 1_000_000
#: A chunk of lower-case Latin letters and then stops; its splitter would cut it there and nowhere else.
_PLAIN = re.compile(r"([a-zà-öø-ɏ]*)([!-&(-/:-@\[-`{-~]*)")


class MergeAutomaton:
    """The automaton of a merge list. ``suffix`` closes a word's last symbol ("" for vocabularies without one)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.labels = {i: t for t, i in vocab.items()}
        left: dict[str, str] = {}
        born: dict[str, int] = {}
        target: dict[str, int] = {}  # of all arcs with this label
        lost: list[dict[str, int]] = [{}]  # by state: labels of the arcs lost, and the merge that took each
        uses = [1 << 60]  # by state: labels that lead there; the start state is never changed

        def present(state: int, token: str) -> bool:
            gone, made = lost[state], len(merges)
            while gone:
                if gone.get(token, len(merges) + 1) <= made:
                    return False
                if token not in left:
                    break
                made, token = born[token], left[token]
            return True

        self._present = present
        derived = {u + v for u, v in merges}
        for t in vocab:
            if t not in derived:
                target[t] = 0
        for i, (u, v) in enumerate(merges):
            w = u + v
            if w in target:
                raise ValueError(f"a token is derived twice: {w!r}")
            if u not in target or v not in target or not present(q := target[u], v):
                continue  # an earlier merge always comes first, so this one never applies
            after = target[v]
            if uses[q] > 1 or u == v:  # others lead there, or w will: the gadget's copy
                uses[q] -= 1
                lost.append(dict(lost[q]))
                uses.append(1)
                target[u] = q = len(lost) - 1
            lost[q][v] = i
            left[w], born[w], target[w] = u, i, after
            uses[after] += 1
        self.target, self.states = target, len(lost)
        self.inner = {t: vocab[t] for t in target if not suffix or not t.endswith(suffix)}
        self.last = {t[: len(t) - len(suffix)]: vocab[t] for t in target if t.endswith(suffix)} if suffix else self.inner
        self.reach: dict[str, int] = {}  # by the first four letters: the longest label that begins so
        for t in (*self.inner, *self.last):
            if len(t) > 3:
                self.reach[t[:4]] = max(len(t), self.reach.get(t[:4], 0))
        self.of = {vocab[t]: s for t, s in target.items()}
        self.table: dict[int, bool] = {}

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-split word, written in the vocabulary's alphabet.

        From the start state the longest labels are followed first. A prefix has one path only, so each position is
        met once at most, however often the way leads back.
        """
        table, inner, last, of, reach = self.table, self.inner.get, self.last.get, self.of, self.reach.get
        n, at, state, end = len(word), 0, 0, min(len(word), reach(word[:4], 3))
        ids: list[int] = []
        way: list[tuple[int, int, int]] = []
        while at < n:
            for k in range(end, at, -1):
                t = (last if k == n else inner)(word[at:k])
                if t is None:
                    continue
                arc = state << 24 | t
                ok = table.get(arc)
                if ok is None:
                    if len(table) > ARCS:
                        table.clear()
                    ok = table[arc] = self._present(state, self.labels[t])
                if ok:
                    way.append((at, k - 1, state))
                    ids.append(t)
                    at, state = k, of[t]
                    end = min(n, k + reach(word[k : k + 4], 3))
                    break
            else:
                if not way:
                    raise ValueError("the vocabulary does not cover this word")
                at, end, state = way.pop()
                ids.pop()
        return ids


class WordBpe:
    """Whole texts for a word-level vocabulary: pre-splitting as in its file, the automaton for the words."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        tok = load(content)
        self.normalizer, self.splitter = tok.normalizer, tok.pre_tokenizer
        self.letters = byte_letters()
        self.words: dict[str, tuple[str, str]] = {}
        self.ids: dict[str, str] = {}
        self.arcs: dict[str, str] = {}
        self.old: tuple[dict[str, str], dict[str, str]] = ({}, {})

    def _word(self, word: str) -> tuple[str, str]:
        """Ids and labels of a word in the vocabulary's alphabet."""
        ids = self.automaton.encode(word)
        found = (" ".join(map(str, ids)), " ".join(map(self.labels.__getitem__, ids)))
        if len(word) <= 64:
            if len(self.words) >= MEMO_SIZE:
                self.words.clear()
            self.words[word] = found
        return found

    def _chunk(self, chunk: str) -> tuple[str, str]:
        if m := _PLAIN.fullmatch(chunk):
            parts = [x if x.isascii() else "".join(map(self.letters.__getitem__, x.encode())) for x in m.groups() if x]
        else:
            parts = [x for x, _ in self.splitter.pre_tokenize_str(chunk)]
        got = [self.words.get(x) or self._word(x) for x in parts]
        return got[0] if len(got) == 1 else tuple(" ".join(x[k] for x in got) for k in (0, 1))

    def _recall(self, missing: set[str], run: set[str]) -> None:
        if len(self.ids) + len(missing) > MEMO_SIZE:
            self.old, self.ids, self.arcs = (self.ids, self.arcs), {}, {}
            missing = run
        ids, arcs = self.old
        for c in missing:
            if c in ids:
                self.ids[c], self.arcs[c] = ids[c], arcs[c]
            else:
                self.ids[c], self.arcs[c] = self._chunk(c)

    def _plain(self, text: str) -> tuple[str, str]:
        if _ODD.search(text):
            text = self.normalizer.normalize_str(text)
            chunks = [c for c in text.split(" ") if c]
        else:
            chunks = text.lower().split()
        out: tuple[list[str], list[str]] = ([], [])
        for at in range(0, len(chunks), RUN):
            run = chunks[at : at + RUN]
            if missing := set(run).difference(self.ids):
                self._recall(missing, set(run))
            out[0].append(" ".join(map(self.ids.__getitem__, run)))
            out[1].append(" ".join(map(self.arcs.__getitem__, run)))
        return " ".join(out[0]), " ".join(out[1])

    def encode(self, text: str) -> tuple[str, str]:
        """Decimal ids and decoded tokens, each joined by one space."""
        parts, rest = [], text
        while found := min(((rest.find(s), -len(s), s) for s in self.special if s in rest), default=None):
            at, _, s = found
            parts += [self._plain(rest[:at]), (str(self.special[s]), s)]
            rest = rest[at + len(s) :]
        if not parts:
            return self._plain(rest)
        parts = [p for p in (*parts, self._plain(rest)) if p[0]]
        return tuple(" ".join(p[k] for p in parts) for k in (0, 1))


_coders: dict[str, WordBpe] = {}


def coder(content: str) -> WordBpe:
    """This worker's automaton for a vocabulary; it and its memo live as long as the worker."""
    if content not in _coders:
        _coders[content] = WordBpe(content)
    return _coders[content]


def encode_decode(docs: DataFrame, vocabulary_name: str = "word_bpe_49k.json", texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``texts`` also ids and decoded.

    Null and empty texts have no tokens, and the digests of the empty string. Repeated rows are encoded each; a
    null doc_id is kept. Only doc_id and text are read, so other columns may have any name. No shuffle.
    """
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_name))  # 2 MB, whatever the input
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if texts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        names = [f.split()[0] for f in schema.split(", ")]
        for b in batches:
            bpe = bpe or coder(content.value)
            rows = []
            for text in b.column(1):
                ids, decoded = bpe.encode(text.as_py() or "")
                digests = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in (ids, decoded)]
                rows.append((ids.count(" ") + 1 if ids else 0, *digests, *((ids, decoded) if texts else ())))
            cols = list(zip(*rows, strict=True)) or [()] * (len(names) - 1)
            kinds = [pa.int64()] + [pa.string()] * (len(names) - 2)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
