"""Secrets in texts: known forms found by one automaton, unknown ones by the entropy of their characters.

All triggers (the fixed beginnings of the known forms) are searched at once by an Aho-Corasick automaton; a form's own
pattern is tried only where its trigger stands. Runs of token characters that no form explains are measured
by the Shannon entropy of their windows. One pass over each text does both. Findings carry place, kind and a hash, never the secret.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, THRESHOLD = 20, 3.0
ENTROPY = "high_entropy"
FINDINGS = "bundle_id string, path string, line_no bigint, start_col int, end_col int, kind string, entropy double, secret_sha256 string"


@dataclass(frozen=True)
class Form:
    """A known form: triggers (lower case, one of them begins each match) and the pattern from there on."""

    kind: str
    triggers: tuple[str, ...]
    pattern: str


# Public forms of credentials.
FORMS = (
    Form("aws_access_key", ("akia", "asia"), r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    Form("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}"),
    Form("slack_token", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Form("google_api_key", ("aiza",), r"AIza[0-9A-Za-z_-]{35}"),
    Form("private_key", ("-----begin",), r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Form("json_web_token", ("eyj",), r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Form(
        "assigned_secret",
        ("password", "passwd", "secret", "token", "api_key", "api-key", "apikey"),
        r"(?i:password|passwd|secret|token|api[_-]?key)[ \t]*[:=][ \t]*(?:\"[^\"\x00-\x20]{8,}\"|'[^'\x00-\x20]{8,}')",
    ),
)
_RUN = re.compile(rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}")
_BREAK = re.compile(r"\r\n|\r|\n")


@lru_cache(maxsize=4)
def _automaton(forms: tuple[Form, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for number, form in enumerate(forms):
        for trigger in form.triggers:
            _, known = found.get(trigger, (len(trigger), ()))
            found.add_word(trigger, (len(trigger), (*known, number)))
    found.make_automaton()
    return found, [re.compile(form.pattern) for form in forms]


@lru_cache(maxsize=1)
def _weights() -> list[float]:
    return [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def window_entropy(run: str) -> float:
    """The largest Shannon entropy (bits per character) of the windows of a run; counts move along with the window."""
    weight = _weights()
    counts: dict[str, int] = {}
    mass = best = 0.0
    for i, new in enumerate(run):
        if i >= WINDOW:
            old = run[i - WINDOW]
            n = counts[old]
            mass += weight[n - 1] - weight[n]
            counts[old] = n - 1
        n = counts.get(new, 0)
        mass += weight[n + 1] - weight[n]
        counts[new] = n + 1
        if i >= WINDOW - 1:
            best = max(best, math.log2(WINDOW) - mass / WINDOW)
    return best


def _lower(text: str) -> str:
    """ASCII letters lower-cased; unlike ``lower`` this keeps every place."""
    return text.translate({c: c + 32 for c in range(65, 91)})


def find_secrets(text: str, forms: tuple[Form, ...] = FORMS, threshold: float = THRESHOLD) -> Iterator[tuple[int, int, str, float | None]]:
    """(start, end, kind, entropy) of the findings of a text, known forms first, each in order of its place."""
    automaton, patterns = _automaton(forms)
    spans: list[tuple[int, int]] = []
    taken = [0] * len(forms)
    for last, (length, numbers) in automaton.iter(_lower(text)) if forms else ():
        start = last - length + 1
        for number in numbers:
            # A form's own matches do not overlap.
            match = patterns[number].match(text, start) if start >= taken[number] else None
            if match:
                taken[number] = match.end()
                spans.append(match.span())
                yield start, match.end(), forms[number].kind, None
    spans.sort()
    starts, reach = [s for s, _ in spans], []
    for _, end in spans:
        reach.append(max(end, reach[-1] if reach else 0))
    for run in _RUN.finditer(text):
        # Explained if a known form overlaps it.
        at = bisect.bisect_left(starts, run.end())
        if at and reach[at - 1] > run.start():
            continue
        body = run.group()
        if any(c.isdigit() for c in body) and any(c.isalpha() for c in body):
            entropy = window_entropy(body)
            if entropy >= threshold:
                yield run.start(), run.end(), ENTROPY, round(entropy, 4)


def secret_scan(texts: DataFrame, forms: tuple[Form, ...] = FORMS, threshold: float = THRESHOLD) -> DataFrame:
    """Findings in rows (bundle_id, path, text): line_no from 1, columns from 1 (``end_col`` is the last one), kind, entropy, secret_sha256.

    A match may reach over a line end only where its form allows it; its line is the one it begins in, and the end counts on from there. Null
    texts have no findings; rows are read one after the other, so memory follows the longest text.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()]
        names = [c.split()[0] for c in FINDINGS.split(", ")]
        for batch in batches:
            rows = []
            for bundle, path, text in zip(*[batch.column(c).to_pylist() for c in ("bundle_id", "path", "text")]):
                begins = None
                for start, end, kind, entropy in find_secrets(text or "", forms, threshold):
                    if begins is None:
                        begins = [0, *(m.end() for m in _BREAK.finditer(text))]
                    line = bisect.bisect_right(begins, start)
                    before = begins[line - 1]
                    digest = hashlib.sha256(text[start:end].encode()).hexdigest()
                    rows.append((bundle, path, line, start - before + 1, end - before, kind, entropy, digest))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return texts.select("bundle_id", "path", "text").mapInArrow(scan, FINDINGS)


def secret_summary(findings: DataFrame) -> DataFrame:
    """(bundle_id, kind, n_findings, n_files, n_secrets): how many, where, and how many different ones."""
    per_file = findings.groupBy("bundle_id", "kind", "path", "secret_sha256").agg(F.count("*").alias("n"))
    return per_file.groupBy("bundle_id", "kind").agg(
        F.sum("n").alias("n_findings"), F.countDistinct("path").alias("n_files"), F.countDistinct("secret_sha256").alias("n_secrets")
    )
