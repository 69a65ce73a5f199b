"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All rules and globs are packed into the bits of a few 64-bit words (Shift-And with
self-loops for wildcards), and a batch of URLs advances through its bytes together, so
one pass of shifts and masks simulates every pattern on every URL.

The canonical URL is host + path: the host is what stands between the first '://' and
the next '/', '?', '#' or the end, with A-Z lower-cased; the path goes on to '?', '#' or the end.
A host/path rule fits its host and all subdomains when the path starts with the rule's;
the longest fitting rule decides.  Where none fits, the globs decide (any fitting
glob blocks); otherwise the URL is allowed.

Defined results: a null URL, or one without '://', has an empty host and path, fits no
rule and is allowed; repeated rows are judged each; an empty table gives an empty
result; a null page_id is kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: host/path rules with their verdicts.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Globs that block where no rule fits: '*' is any run of characters, '?' any one character.
GLOBS = ["ads.*", "*.ads.*", "adserver.*", "*/ads/*", "*/adserver/*", "*/banners/*", "*/wp-login.php*", "*/wp-admin/*", "*/cgi-bin/*", "*/cart/checkout*", "*casino*", "*.exe", "*.zip", "*.apk", "*/track?r/*", "*/login"]


#: Bytes that are in a UTF-8 character but do not begin one.
FURTHER = np.arange(256) & 0xC0 == 0x80


class Automaton:
    """Patterns as tokens: a byte, None for one character, '*' for any run, '~' for any run without '/'."""

    def __init__(self, patterns: list[list]) -> None:
        states = [1 + sum(t not in ("*", "~") for t in p) for p in patterns]
        words = -(-sum(states) // 64) or 1
        self.step, self.loop = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        self.begin, self.final = np.zeros(words, np.uint64), []
        at = 0
        for p, n in zip(patterns, states, strict=True):
            self._set(self.begin[None, :], slice(None), at)
            bit = at
            for t in p:
                if t in ("*", "~"):
                    fits = np.ones(256, bool)
                    fits[ord("/")] = t == "*"
                    self._set(self.loop, fits, bit)
                else:
                    bit += 1
                    self._set(self.step, ~FURTHER if t is None else t, bit)
                    if t is None:  # the further bytes of a character stay where its first has led
                        self._set(self.loop, FURTHER, bit)
            self.final.append(bit)
            at += n

    @staticmethod
    def _set(masks: np.ndarray, rows, bit: int) -> None:
        masks[rows, bit // 64] |= np.uint64(1 << (bit % 64))

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which pattern fits which row: rows x patterns."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0)) + 1), side="left")
        state = np.repeat(self.begin[None, :], len(size), axis=0)
        start = offsets[:-1][order]
        for i in range(int(size.max(initial=0))):
            n = live[i]
            c = data[start[:n] + i]
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[c]) | (now & self.loop[c])
        out = np.zeros((len(size), len(self.final)), bool)
        for j, bit in enumerate(self.final):
            out[order, j] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return out


def glob_tokens(glob: str) -> list:
    return [{"*": "*", "?": None}.get(chr(b), b) for b in glob.encode()]


def compiled(rules: list[tuple[str, str, str]], globs: list[str]) -> tuple[Automaton, list[int]]:
    """The automaton, and the rule of each pattern (the number of rules for a glob)."""
    patterns, of = [], []
    for i, (host, path, _) in enumerate(rules):
        for lead in ([], ["~", ord(".")]):
            patterns.append([*lead, *(host + path).encode(), "*"])
            of.append(i)
    for g in globs:
        patterns.append(glob_tokens(g))
        of.append(len(rules))
    return Automaton(patterns), of


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical(url: str | None) -> tuple[str, str]:
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((p for p in map(rest.find, "?#") if p >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    cut = end if slash < 0 else slash
    return rest[:cut].translate(LOWER), rest[cut:end]


def judge(pages: DataFrame, rules=RULES, globs=GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    rules = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    automaton, of = compiled(rules, globs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "url"):
            parts = [canonical(u) for u in batch.column(1).to_pylist()]
            fits = automaton.run(*common.flat(pa.array([h + p for h, p in parts], pa.string())))
            by = np.zeros((len(parts), len(rules) + 1), bool)
            for j, i in enumerate(of):
                by[:, i] |= fits[:, j]
            first = np.where(by[:, :-1].any(axis=1), by[:, :-1].argmax(axis=1), -1) if rules else np.full(len(parts), -1)
            rule = [rules[i][0] + rules[i][1] if i >= 0 else None for i in first]
            verdict = [rules[i][2] if i >= 0 else "block" if g else "allow" for i, g in zip(first, by[:, -1], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url").mapInArrow(work, "page_id long, host string, path string, rule string, verdict string")


def op2_url_filter(spark, sf_dir):
    return judge(common.table(spark, sf_dir, "pages", "page_id", "url"))


def _like(glob: str) -> str:
    return glob.replace("_", "\\_").replace("%", "\\%").replace("*", "%").replace("?", "_")


SQL = f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (
  SELECT *, CASE {" ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))} END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in RULES)}
            WHEN {" OR ".join(f"host || path LIKE '{_like(g)}' ESCAPE '{chr(92)}'" for g in GLOBS)} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
