"""License scan with a generalised suffix automaton of licence tokens."""

from __future__ import annotations

import re
import uuid
from bisect import bisect, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import all_templates

PIECE = 1 << 20  # characters of a text that are worked on at once
_made: dict[str, Matcher] = {}  # of the scan that this worker is at
TOKEN = re.compile(r"\w+")
SCHEMA = "doc_id bigint, license string, template int, start int, end int, matched_tokens int, coverage double"


def lowered(text: str) -> str:
    """In lower case, as long as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(lowered(text))


class SuffixAutomaton:
    """All factors of several token sequences; each state knows where in which of
    them its factors end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        self._ends = ends
        for no, seq in enumerate(sequences):
            last = 0
            for at, c in enumerate(seq):
                last = self._extend(last, c)
                ends[last].add((no, at + 1))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.ends = [sorted(e) for e in ends]

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self._ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    def statistics(self, seq: list[int], start: int):
        """Matching statistics of a stream: for each token (position, length of the
        longest suffix that is a factor, its state)."""
        state = length = 0
        for at, c in enumerate(seq, start):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (q := self.next[state].get(c)) is not None:
                state, length = q, length + 1
            else:
                length = 0
            yield at, length, state


class Matcher:
    """The automaton of a set of templates and the chaining of its long matches."""

    def __init__(self, templates: dict[str, list[str]], min_match: int, min_coverage: float, max_gap: int):
        self.min_match, self.min_coverage, self.max_gap = min_match, min_coverage, max_gap
        self.ids: dict[str, int] = {}
        self.names = [(name, no) for name, texts in templates.items() for no in range(len(texts))]
        seqs = [[self.ids.setdefault(w, len(self.ids)) for w in tokens(t)] for texts in templates.values() for t in texts]
        self.sizes = [len(s) for s in seqs]
        self.need = [max(1, int(np.ceil(min_coverage * n - 1e-9))) for n in self.sizes]
        self.automaton = SuffixAutomaton(seqs)
        # runs of min_match tokens, and the fewest tokens that a span of a template that has the run must match
        keys = [self._keys(np.array(s, dtype=np.int64)) for s in seqs]
        every, least = np.concatenate(keys or [np.zeros(0, np.int64)]), np.concatenate([np.full(len(k), n) for k, n in zip(keys, self.need)] or [np.zeros(0, np.int64)])
        order = np.lexsort((least, every))
        every, least = every[order], least[order]
        new = np.append(True, every[1:] != every[:-1])[: len(every)]
        self.grams, self.gram_need = every[new], least[new]

    def _keys(self, ids: np.ndarray) -> np.ndarray:
        """Runs of min_match known tokens as numbers; -1 where one is unknown."""
        n = max(0, len(ids) - self.min_match + 1)
        key, ok = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for j in range(self.min_match):
            part = ids[j : j + n]
            key = (key * (len(self.ids) + 1) + part) % ((1 << 61) - 1)
            ok &= part >= 0
        return np.where(ok, key, -1)

    def _hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, where a run of min_match tokens begins that some template has, least need of their templates)."""
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        keys = self._keys(ids)
        if not len(keys) or not len(self.grams):
            return ids, np.zeros(0, np.int64), 0
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[at] == keys)
        return ids, hit, int(self.gram_need[at[hit]].min(initial=1 << 40))

    def matches(self, ids: np.ndarray, hit: np.ndarray, most: int) -> dict[int, list[tuple[int, int, int]]]:
        """(first token, length, place in the template) of the long matches that can't be extended, by template; only of those
        that ``most`` matched tokens could cover. A long match lies in tokens that are covered by runs that some template has."""
        covered = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + self.min_match, -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(covered)[:-1] > 0).astype(np.int8), [0]])))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for lo, hi in edges.reshape(-1, 2).tolist():
            before = (0, 0, 0)
            for now in [*self.automaton.statistics(ids[lo:hi].tolist(), lo), (hi, 0, 0)]:
                if before[1] >= self.min_match and now[1] <= before[1]:  # it can't be extended
                    for no, end in self.automaton.ends[before[2]]:
                        if self.need[no] <= most:
                            found.setdefault(no, []).append((before[0] + 1 - before[1], before[1], end - before[1]))
                before = now
        return found

    def spans(self, words: list[str]):
        """(template, first token, end token, matched tokens, coverage), apart from
        each other, in order."""
        ids, hit, least = self._hits(words)
        most = int(np.minimum(np.diff(np.append(hit, len(words) + self.min_match)), self.min_match).sum()) if len(hit) else 0
        if not len(hit) or least > most:
            return []
        chains = [c for no, found in self.matches(ids, hit, most).items() for c in self._chains(no, found)]
        chains.sort(key=lambda c: (-c[3], -c[4], c[1], c[0]))
        taken: list[tuple] = []  # (first token, end token, ...), in order and apart from each other
        for no, lo, hi, *rest in chains:
            k = bisect(taken, (lo,))
            if (k == 0 or taken[k - 1][1] <= lo) and (k == len(taken) or hi <= taken[k][0]):
                insort(taken, (lo, hi, no, *rest))
        return [(no, lo, hi, *rest) for lo, hi, no, *rest in taken]

    def find(self, text: str):
        """(template, first character, end, matched tokens, coverage). A long text is worked on in pieces, which end where no template has anything
        in so many tokens that no chain goes on; one without such a place is a longer piece."""
        at, size = 0, PIECE
        while at < len(text):
            end = at + size
            while end < len(text) and (text[end].isalnum() or text[end] == "_"):
                end += 1
            low = lowered(text[at:end])
            places = [m.span() for m in TOKEN.finditer(low)]
            words, keep = [low[a:b] for a, b in places], None
            if end < len(text):
                _, hit, _ = self._hits(words)
                gap = self.max_gap + 2 * self.min_match
                ends = np.append(0, hit + self.min_match)
                wide = np.flatnonzero(np.append(hit, len(words)) - ends > gap)
                keep = int(ends[wide[-1]]) + gap // 2 if len(wide) else 0
                if not keep:
                    size *= 2
                    continue
            for no, lo, hi, n, share in self.spans(words[:keep]):
                yield no, at + places[lo][0], at + places[hi - 1][1], n, share
            at, size = (end if keep is None else at + places[keep][0]), PIECE

    def _chains(self, no: int, matches: list[tuple[int, int, int]]):
        """Matches that follow each other in text and template, with gaps of at most
        max_gap tokens, make one span; kept if they cover enough of the template."""
        matches = sorted(set(matches))
        open_chains: list[list[int]] = []  # first token, end token, end in template, matched
        done = []
        for at, length, t in matches:
            done += [c for c in open_chains if at - c[1] > self.max_gap]
            open_chains = [c for c in open_chains if at - c[1] <= self.max_gap]
            fits = [c for c in open_chains if t + length > c[2] and at + length > c[1] and -length < t - c[2] <= self.max_gap and (at - c[1] >= 0 or t - c[2] >= at - c[1])]
            if fits:
                best = max(fits, key=lambda c: c[3])
                gain = min(length, at + length - best[1], t + length - best[2])
                best[1], best[2], best[3] = at + length, t + length, best[3] + gain
            else:
                open_chains.append([at, at + length, t + length, length])
        for lo, hi, _, n in done + open_chains:
            if (share := n / self.sizes[no]) >= self.min_coverage:
                yield no, lo, hi, n, round(min(1.0, share), 4)


def _matcher(key: str, shared, min_match: int, min_coverage: float, max_gap: int) -> Matcher:
    """The matcher of a scan, made by the first of a worker's tasks."""
    if key not in _made:
        _made.clear()
        _made[key] = Matcher(shared.value, min_match, min_coverage, max_gap)
    return _made[key]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, min_match: int = 3, min_coverage: float = 0.7, max_gap: int = 6) -> DataFrame:
    """One row for each licence span: ``doc_id, license, template, start, end, matched_tokens, coverage``.

    The lower-cased ``\\w+`` tokens of each text are streamed through a generalised
    suffix automaton of all templates. Matches of at least ``min_match`` tokens that
    can't be extended are chained where they follow each other in text and template
    (gaps of at most ``max_gap`` tokens); a chain that covers ``min_coverage`` of its
    template is a span. Where spans overlap, the one with most matched tokens stays
    (ties: coverage, then place, then order of the templates). ``start`` and ``end``
    are character offsets. ``template`` is the number of the licence's template.

    Whole texts are streamed, long ones in pieces; tokens that no run of ``min_match`` tokens of a template covers are skipped, as are templates that
    the covered tokens are too few for, which
    changes no match. Of a text's place the longest match is taken; a template that has only a part of it isn't credited with that part.
    By default the templates are notices of common licences and the whole texts of fourteen. The automaton is made once in each worker.
    NULL and empty texts give no rows, ids are whole numbers, NULL ids come back as they are,
    rows that repeat are reported again, other columns are ignored, an empty table gives no rows.
    """
    given = all_templates() if templates is None else templates
    shared, key = docs.sparkSession.sparkContext.broadcast(given), uuid.uuid4().hex
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text <> ''")

    def scan(batches):
        matcher = _matcher(key, shared, min_match, min_coverage, max_gap)
        for batch in batches:
            rows = [(doc, *matcher.names[no], *rest) for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]) for no, *rest in matcher.find(text.as_py())]
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "template", "start", "end", "matched_tokens", "coverage"])

    return base.mapInArrow(scan, SCHEMA)


def op6_license_scan(spark, sf_dir) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
