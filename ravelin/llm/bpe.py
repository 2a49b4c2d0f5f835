"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, one after another, into a deterministic automaton whose arcs are tokens and whose language is the
set of correct tokenizations. At first there is one state with an arc for every byte. The gadget for the merge (a, b) takes
the state q that all a-arcs lead to, makes a copy of it without the b-arc, turns the a-arcs to the copy, and gives an ab-arc
to every state that has an a-arc. All arcs with one label lead to one state throughout, so states are held as the chains of
copies that they are: a state knows the label whose merges made its latest copies, the last of those merges, and where the label's
arcs led before; the arcs that copies lack are one table of (label, lacking arc). That keeps 50,000 gadgets in a few MB. Arcs that
a task has asked for are kept in a transition table from (state, label) to the next state. A text has exactly one path.

Words are encoded together: at each byte offset, a trie of the arc labels is walked by table for all words at once, and an
arc is taken where the transition table leads on. Each offset is reached by one arc at most, so the path is read back from the end.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import HashTable, fresh, list_chunks

#: Words of more bytes than this are walked one by one instead of in step with others.
LONG_WORD = 48
#: Fixed value: how the byte-level scheme splits a text before merging, with white space as Unicode defines it.
BLANK = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable bytes stand for themselves, others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Arc labels are numbered 0-255 for bytes and then in merge order; `ids` maps them to the vocabulary's ids."""

    def __init__(self, merges: list[tuple[bytes, bytes]], vocabulary: dict[bytes, int], special: dict[str, int]):
        label: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.n = n = 256 + len(merges)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.text: list[bytes] = [bytes([b]) for b in range(256)]
        #: Of each state but the first: the label whose merges made its latest copies, and the last of these merges.
        owner, made = [-1], [-1]
        #: Of each label: the state that its arcs lead to, and the one that they led to when it was made.
        goal, base = [0] * 256, [0] * 256
        for a, b in merges:
            x, y, k = label[a], label[b], len(self.text)
            goal.append(goal[y])  # the ab-arcs lead where b-arcs led
            base.append(goal[y])
            owner.append(x)
            made.append(k)
            goal[x] = len(owner) - 1  # and the a-arcs to the copy, whatever their start; with a = b the ab-arcs keep the old state
            label[a + b] = k
            self.left[k], self.right[k] = x, y
            self.text.append(a + b)
        self.owner, self.made, self.goal, self.base = (np.array(x, np.int64) for x in (owner, made, goal, base))
        self.ids = np.array([vocabulary[t] for t in self.text], np.int64)
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.special = special
        #: Which merge made the copy of the label's state that lacks the arc.
        self.lacks = HashTable(np.array([label[a] * n + label[b] for a, b in merges], np.int64), np.arange(256, n, dtype=np.int64))
        self._trie(label)
        self._emit()
        #: The transition table: keys (state, label) and next states, -1 for no arc; filled as arcs are asked for.
        self.table_keys, self.table_goals = np.full(1 << 20, -1, np.int64), np.full(1 << 20, -1, np.int32)

    def _trie(self, label: dict[bytes, int]) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        for t in self.text:
            for i in range(1, len(t) + 1):
                nodes.setdefault(t[:i], len(nodes))
        keys, values = np.empty(len(nodes) - 1, np.int64), np.empty(len(nodes) - 1, np.int64)
        self.ends = np.full(len(nodes), -1, np.int64)
        for i, (t, k) in enumerate(list(nodes.items())[1:]):
            keys[i], values[i] = nodes[t[:-1]] * 256 + t[-1], k
            self.ends[k] = label.get(t, -1)
        self.trie = HashTable(keys, values)

    def _emit(self) -> None:
        """What each id spells, as one run of bytes with offsets by id."""
        by_id = {int(i): t for i, t in zip(self.ids, self.text, strict=True)} | {i: s.encode() for s, i in self.special.items()}
        spelt = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_at = np.concatenate([[0], np.cumsum([len(t) for t in spelt])])

    @classmethod
    def load(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], byte_letters()
        spell = lambda t: bytes(byte[c] for c in t)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls([(spell(a), spell(b)) for a, b in pairs], {spell(t): i for t, i in model["vocab"].items() if t not in special}, special)

    def _arcs(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether the state has an arc with the label, by going down the copies that it was made by.

        A copy that lacks the arc ends the search. A label that is younger than a copy came to it with the arc of its left part, so
        the left part is looked for among the copies older than the label. (The copy that the merge of a with a makes lacks the a-arc
        already when aa-arcs are given, hence <=.)
        """
        out, s = np.ones(len(state), bool), state.copy()
        rows = np.flatnonzero(s > 0)
        while len(rows):
            x, upto = self.owner[s[rows]], self.made[s[rows]]
            y, before, at = label[rows].copy(), np.full(len(rows), NEVER), np.arange(len(rows))
            while len(at):
                made = self.lacks.get(x[at] * self.n + y[at])
                lost = (made >= 0) & (made <= upto[at]) & (made <= before[at])
                out[rows[at[lost]]] = False
                at = at[~lost & (self.left[y[at]] >= 0)]
                before[at] = y[at]
                y[at] = self.left[y[at]]
            s[rows] = self.base[x]
            rows = rows[out[rows] & (s[rows] > 0)]
        return out

    def step(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The next states, or -1; a table of fixed size answers what it has met."""
        keys = state * self.n + label
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = self.table_goals[at].astype(np.int64)
        new = np.flatnonzero(self.table_keys[at] != keys)
        if len(new):
            out[new] = np.where(self._arcs(state[new], label[new]), self.goal[label[new]], -1)
            self.table_keys[at[new]], self.table_goals[at[new]] = keys[new], out[new]
            clash = new[self.table_keys[at[new]] != keys[new]]  # two keys of one slot: the slot keeps neither
            self.table_keys[at[clash]] = -1
        return out

    def encode_long(self, word: bytes, tile: int = 1 << 14) -> list[int]:
        """The same path for one word of any length: the labels at all offsets of a tile are looked up at once, then walked in order."""
        raw, n = np.frombuffer(word, np.uint8).astype(np.int64), len(word)
        last, state, known = [-1] * (n + 1), [-1] * (n + 1), {}
        state[0] = 0
        for first in range(0, n, tile):
            at = np.arange(first, min(first + tile, n))
            node, depth, found = np.zeros(len(at), np.int64), 0, [[] for _ in at]
            while len(at):
                node = self.trie.get(node * 256 + raw[at + depth])
                for i in np.flatnonzero((node >= 0) & (self.ends[node] >= 0)).tolist():
                    found[int(at[i]) - first].append(int(self.ends[node[i]]))
                depth += 1
                live = (node >= 0) & (at + depth < n)
                at, node = at[live], node[live]
            for i, labels in enumerate(found, first):
                if state[i] < 0:
                    continue
                for u in labels:
                    key = (state[i], u)
                    if key not in known:
                        known[key] = int(self.step(np.array([state[i]]), np.array([u]))[0])
                    if known[key] >= 0:
                        to = i + int(self.size[u])
                        last[to], state[to] = u, known[key]
        out, at = [], n
        while at:
            out.append(last[at])
            at -= int(self.size[last[at]])
        return out[::-1]

    def encode_words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Labels of all words' paths, one after another, and len + 1 offsets."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        paths: dict[int, list[int]] = {}
        counts, runs = np.zeros(len(pieces), np.int64), []
        for i in np.flatnonzero(size > LONG_WORD):
            paths[i] = self.encode_long(pieces[i])
            counts[i] = len(paths[i])
        short = np.flatnonzero((size > 0) & (size <= LONG_WORD))
        short = short[np.argsort(-size[short], kind="stable")]
        for at in range(0, len(short), 1 << 16):
            rows = short[at : at + (1 << 16)]
            n, wide = size[rows], int(size[rows[0]])
            grid = np.zeros((len(rows), wide), np.int64)
            grid[np.arange(wide) < n[:, None]] = np.frombuffer(b"".join([pieces[i] for i in rows]), np.uint8)
            last = np.full((wide + 1, len(rows)), -1, np.int64)
            for i in range(wide):
                live = int(np.searchsorted(-n, -i))  # those longer than i come first
                here = np.arange(live) if i == 0 else np.flatnonzero(last[i, :live] >= 0)
                node, state = np.zeros(len(here), np.int64), np.where(last[i, here] >= 0, self.goal[last[i, here]], 0)
                for j in range(i, wide):
                    keep = n[here] > j
                    if not keep.all():
                        here, node, state = here[keep], node[keep], state[keep]
                    node = self.trie.get(node * 256 + grid[here, j])
                    keep = node >= 0
                    here, node, state = here[keep], node[keep], state[keep]
                    if not len(here):
                        break
                    u = self.ends[node]
                    arcs = np.flatnonzero(u >= 0)
                    taken = arcs[self.step(state[arcs], u[arcs]) >= 0]
                    last[j + 1, here[taken]] = u[taken]
            back, pos, who = [], n.copy(), np.arange(len(rows))
            while len(who):
                arc = last[pos[who], who]
                back.append((who, arc))
                pos[who] -= self.size[arc]
                who = who[pos[who] > 0]
            owner, arc = np.concatenate([b[0] for b in back]), np.concatenate([b[1] for b in back])
            step = np.repeat(np.arange(len(back)), [len(b[0]) for b in back])
            order = np.lexsort((-step, owner))
            counts[rows] = np.bincount(owner, minlength=len(rows))
            runs.append((rows, arc[order]))
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(ends[-1], np.int64)
        for rows, arcs in runs:
            out[spread(ends[rows], counts[rows])] = arcs
        for i, path in paths.items():
            out[ends[i] : ends[i + 1]] = path
        return out, ends


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as often as its count says."""
    total = np.cumsum(counts)
    return np.repeat(starts - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)


class Codec:
    """Encodes and decodes pre-split texts; words met before in the task are looked up."""

    def __init__(self, automaton: Automaton, remember: int = 200_000):
        self.a, self.remember = automaton, remember
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and len + 1 offsets."""
        if len(self.known) > self.remember:
            self.forget()
        coded = pieces.flatten().dictionary_encode()
        words, known, before = coded.dictionary.to_pylist(), self.known, len(self.known)
        number = np.fromiter((known.setdefault(p, len(known)) for p in words), np.int64, len(words))
        if len(known) > before:
            new = list(islice(known, before, None))
            arcs, ends = self.a.encode_words([b"" if p in self.a.special else p.encode() for p in new])
            ids = self.a.ids[arcs]
            for i in [i for i, p in enumerate(new) if p in self.a.special]:
                ids = np.insert(ids, ends[i], self.a.special[new[i]])
                ends[i + 1 :] += 1
            self.flat, self.ends = np.concatenate([self.flat, ids]), np.concatenate([self.ends, ends[1:] + self.ends[-1]])
        index = number[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        counts = self.ends[index + 1] - self.ends[index]
        at = pieces.offsets.to_numpy().astype(np.int64)
        return self.flat[spread(self.ends[index], counts)], np.concatenate([[0], np.cumsum(counts)])[at - at[0]]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        size = self.a.spelt_at[ids + 1] - self.a.spelt_at[ids]
        at = np.concatenate([[0], np.cumsum(size)])[ends].tolist()
        raw = self.a.spelt[spread(self.a.spelt_at[ids], size)].tobytes()
        return [raw[i:j].decode("utf-8", "replace") for i, j in zip(at, at[1:])]


def pre_split(text: Column, special: list[str]) -> Column:
    """The words that merges stay within; a special token is a word of its own, and splits what stands around it."""
    words = lambda c: F.regexp_extract_all(c, F.lit(SPLIT), F.lit(0))
    text = F.coalesce(text, F.lit(""))
    if not special:
        return words(text)
    marks = "|".join(f"\\Q{s}\\E" for s in sorted(special, key=len, reverse=True))
    parts = F.split(text, "|".join(f"(?<=\\Q{s}\\E)|(?=\\Q{s}\\E)" for s in special))
    apart = F.flatten(F.transform(parts, lambda p: F.when(p.isin(special), F.array(p)).otherwise(words(p))))
    return F.when(text.rlike(marks), apart).otherwise(words(text))


def with_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", tokens: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds `tokens` (array<int>) and `decoded` (the text read back from them).

    A null or empty text has no tokens and decodes to an empty text. Columns named like the new ones are replaced; repeated rows
    are encoded alike; an empty table stays empty. Special tokens that stand in a text get their own ids. Memory: an Arrow batch in
    slices of some thousand words, and at most `remember` words and those of one slice, besides the compiled automaton (some 30 MB),
    which is broadcast and whose size depends on the tokenizer alone.
    """
    automaton = Automaton.load(tokenizer_path)
    model = docs.sparkSession.sparkContext.broadcast(automaton)
    empty = pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("text", pa.string())]))

    @F.arrow_udf("struct<ids array<int>, text string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(model.value)
        for pieces in batches:
            parts = [empty]
            for some in list_chunks(pieces):
                ids, ends = codec.encode(some)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                parts.append(pa.StructArray.from_arrays([lists, pa.array(codec.decode(ids, ends), pa.string())], ["ids", "text"]))
            yield pa.concat_arrays(parts)

    new = fresh("bpe")
    out = docs.withColumn(new, both(pre_split(F.col(text), sorted(automaton.special))))
    return out.withColumns({tokens: F.col(f"{new}.ids"), decoded: F.col(f"{new}.text")}).drop(new)


def digests(tokens: str, decoded: str) -> list[Column]:
    """n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the text in UTF-8)."""
    ids = F.array_join(F.col(tokens).cast("array<string>"), ",")
    return [F.size(tokens).cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col(decoded), 256).alias("decoded_sha256")]
