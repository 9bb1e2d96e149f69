"""URL filters: all rules at once, by a bit-parallel automaton.

A rule is a glob over a canonical URL (host in lower case, then path): ``*``
stands for any characters, ``?`` for one. All rules are packed into one row of
64-bit words, a bit for each character. Reading a character moves every bit one
place up (with carry between words) and keeps those whose character fits; bits
before a ``*`` also stay where they are. A site rule's bits live in one part of
the URL only: those before its first ``/`` while the host is read, the others in
the path. The URLs of a batch are read side by side, longest first, so each step
is a few operations on whole arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semcat.llm.rows import with_arrays

ROWS = 4096
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    globs: tuple[str, ...]
    rank: int  # of the rules that fit, the greatest decides; then the first
    site: bool = False  # whether what stands before a glob's first ``/`` is the host, the rest the path


def site_rule(name: str, verdict: str) -> Rule:
    """A rule such as ``example.net/en/``: this host and all its subdomains, paths that start so; longer ones win."""
    # without a path, the host may also be all there is
    ends = ("*",) if "/" in name else ("", "/*")
    globs = tuple(f"{start}{name}{end}" for start in ("", "*.") for end in ends)
    return Rule(name, verdict, globs, 1_000_000 + len(name), True)


def url_globs(name: str, verdict: str, *globs: str) -> Rule:
    """A rule of lower rank than every site rule."""
    return Rule(name, verdict, globs, 0)


class Automaton:
    """Shift-And masks of a list of globs; those that are of a ``site`` keep host and path apart."""

    def __init__(self, globs: list[str], site: list[bool] | None = None):
        characters, alphabet = [], {}
        starts, self.final, empty = [], [], []
        free_start, stays = [], []
        hosts, paths = [], []
        n = 0
        for glob, apart in zip(globs, site or [False] * len(globs)):
            begin, leading, place = n, False, hosts
            for c in glob:
                if c == "/":
                    place = paths
                if c == "*":
                    if n == begin:
                        leading = True
                    else:
                        stays.append(n - 1)
                    continue
                if apart:
                    place.append(n)
                characters.append(c)
                n += 1
            if n == begin:
                # only stars, or nothing at all: no bit, the answer hangs on the length alone
                self.final.append(-1)
                empty.append(leading)
                continue
            empty.append(False)
            starts.append(begin)
            if leading:
                free_start.append(begin)
            self.final.append(n - 1)
        self.empty = np.array(empty, bool)
        self.words = max(1, -(-n // 64))
        self.start = self._mask(starts)
        self.free_start = self._mask(free_start)
        self.stays = self._mask(stays)
        # bits that may be set while the host is read, and while the path is
        self.parts = ~np.stack((self._mask(paths), self._mask(hosts))) if hosts or paths else None
        for c in characters:
            if c != "?":
                alphabet.setdefault(c, len(alphabet) + 1)
        any_one = [i for i, c in enumerate(characters) if c == "?"]
        self.fits = np.tile(self._mask(any_one), (len(alphabet) + 1, 1))
        for c, k in alphabet.items():
            self.fits[k] |= self._mask([i for i, x in enumerate(characters) if x == c])
        codes = np.array(sorted(ord(c) for c in alphabet), np.uint32)
        self.codes = codes
        self.class_of = np.array([alphabet[chr(c)] for c in codes], np.int64)
        at = np.array(self.final, np.int64)
        self.final_word, self.final_bit = np.maximum(at, 0) // 64, (np.maximum(at, 0) % 64).astype(np.uint64)

    def _mask(self, bits: list[int]) -> np.ndarray:
        mask = np.zeros(self.words, np.uint64)
        for b in bits:
            mask[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return mask

    def classes(self, text: str) -> np.ndarray:
        """Each character's row of masks; 0 for those that no rule names."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(self.codes):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.class_of[at], 0)

    def fitting(self, texts: list[str]) -> np.ndarray:
        """(text, glob): which globs fit which whole text; a text's host ends before its first ``/``."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        read = [self.classes(texts[i]) for i in order]
        length = np.array([len(r) for r in read])
        flat = np.concatenate([*read, np.zeros(1, np.int64)])
        begin = np.concatenate(([0], np.cumsum(length)[:-1])) if len(read) else length
        state = np.zeros((len(texts), self.words), np.uint64)
        active = len(texts)
        hosts = np.array([len(t.partition("/")[0]) for t in (texts[i] for i in order)], np.int64)
        one = np.uint64(1)
        for step in range(int(length[0]) if len(length) else 0):
            while active and length[active - 1] <= step:
                active -= 1
            s = state[:active]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            # no rule's last bit may move into the next rule's first one
            moved &= ~self.start
            moved |= self.start if step == 0 else self.free_start
            state[:active] = (moved & self.fits[flat[begin[:active] + step]]) | (s & self.stays)
            if self.parts is not None:
                state[:active] &= self.parts[(hosts[:active] <= step).astype(np.int64)]
        hit = (state[:, self.final_word] >> self.final_bit) & one == one
        without = np.array(self.final, np.int64) < 0
        if without.any():
            hit[:, without] = self.empty[without] | (length == 0)[:, None]
        out = np.empty_like(hit)
        out[order] = hit
        return out


def judge(pages: DataFrame, rules: list[Rule], default: str, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (its own, else ``default``).

    Of the rules that fit, the one of the greatest rank decides, among equals the
    first listed. Null URLs and those without ``://`` have an empty host and path
    and fit only rules that fit nothing at all. Columns named as the new ones are
    replaced, all others are kept.
    """
    globs = [(r, g) for r, rule in enumerate(rules) for g in rule.globs]
    machine = Automaton([g for _, g in globs], [rules[r].site for r, _ in globs])
    shared = pages.sparkSession.sparkContext.broadcast((machine, [r for r, _ in globs]))
    strength = np.array([rule.rank * 1_000_000 - r for r, rule in enumerate(rules)], np.int64)
    names = pa.array([rule.name for rule in rules], pa.string())
    verdicts = pa.array([*[rule.verdict for rule in rules], default], pa.string())

    def run(column: pa.Array) -> list[pa.Array]:
        automaton, owner = shared.value
        chosen: list[np.ndarray] = []
        for a in range(0, len(column), ROWS):
            texts = [x or "" for x in column.slice(a, ROWS).to_pylist()]
            hit = automaton.fitting(texts)
            best = np.full(len(texts), -1)
            power = np.full(len(texts), np.iinfo(np.int64).min)
            for g, r in enumerate(owner):
                better = hit[:, g] & (strength[r] > power)
                best[better], power[better] = r, strength[r]
            chosen.append(best)
        best = np.concatenate(chosen) if chosen else np.zeros(0, int)
        none = best < 0
        rule = names.take(pa.array(np.maximum(best, 0), mask=none)) if len(rules) else pa.nulls(len(best), pa.string())
        return [rule, verdicts.take(pa.array(np.where(none, len(rules), best)))]

    rows = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    rows = rows.withColumn("_url", F.concat("host", "path"))
    return with_arrays(rows, "_url", {"rule": T.StringType(), "verdict": T.StringType()}, run).drop("_url")
