"""The scan: texts in, a relation of findings out.

One Arrow stage does all the work of a text: it undoes obfuscation, finds keywords with an automaton, tries the
expressions that can match, checks values, gates, scores and resolves overlaps, and emits findings only.
Expressions of one unbroken run of letters and digits (most of the catalogue) are tried on the text's runs with a
digit, chosen by length, instead of on the whole text. Nothing is shuffled, joined or collected.

Defined results: null, empty and oversized texts give no findings (``statuses`` tells which); repeated rows are scanned
each for itself; spans are UTF-8 bytes of the original text; ties keep catalogue order, then order of occurrence. Texts of
which a bound of the configuration cut matches off are marked ``scan_truncated`` by ``scan_documents``.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from re._parser import parse as sre_parse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.catalog.patterns import Pattern, catalogue
from veilframe.functions import scoring, text
from veilframe.functions.checks import CHECKS
from veilframe.functions.normalize import alternatives, normalize
from veilframe.session import spread

MOST_BYTES = 10 * 1024 * 1024
LONGEST = 200  # of a run of letters and digits; expressions without an upper end are tried up to it by length


@dataclass(frozen=True)
class ScanConfig:
    categories: frozenset[str] | None = None
    require_context: bool = False
    max_matches: int = 50_000
    deduplicate: bool = True
    min_confidence: float = 0.0
    baseline_only: bool = False
    disabled: frozenset[tuple[str, str]] = frozenset()
    unique_limits: tuple[tuple[str, int], ...] = ()  # (sub-category, least number of different values), applied by ``findings.unique_threshold``
    patterns: tuple[Pattern, ...] | None = None
    per_pattern: int = 10_000  # matches of an expression in a text
    most_bytes: int = MOST_BYTES
    alternative_bytes: int = 4096  # longer texts have no other readings
    ignore_marker: str = ""  # findings on a line with it are left out
    validators: tuple[tuple[str, Callable[[str, str], bool]], ...] = ()  # (name, function of sub-category and text): all must hold

    def active(self) -> tuple[Pattern, ...]:
        """The catalogue pruned by category and baseline, on the driver, before anything runs."""
        chosen = self.patterns or catalogue()
        return tuple(p for p in chosen if (self.categories is None or p.category in self.categories) and (p.always_run or not self.baseline_only))


class Keywords:
    """Leftmost-longest search for all keywords at once; positions by pattern."""

    def __init__(self, patterns: tuple[Pattern, ...]) -> None:
        owners: dict[str, list[int]] = {}
        for p in patterns:
            for k in p.keywords:
                owners.setdefault(k.lower(), []).append(p.pattern_id)
        self.owners = owners
        try:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for k in owners:
                self.automaton.add_word(k, k)
            self.automaton.make_automaton()
            self.plain = None
        except ImportError:
            self.plain = re.compile("|".join(re.escape(k) for k in sorted(owners, key=len, reverse=True)))

    def hits(self, low: str) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        if self.plain is None:
            places = ((end - len(k) + 1, k) for end, k in self.automaton.iter_long(low))
        else:
            places = ((m.start(), m.group()) for m in self.plain.finditer(low))
        for at, k in places:
            for p in self.owners[k]:
                found.setdefault(p, []).append(at)
        return found


ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Fixed strings, one of which (between bars) every match has, looked for in the lower-cased text.
NEEDS = {
    "Masked PAN": "**|xx|*x|x*", "Track 1 Data": "%b", "Generic Secret Assignment": "secret|password|passwd|pwd|token", "IPv4 Address": ".", "MICR Line": "⑆|⑇|⑈|⑉", "Hong Kong ID": "(|0|1|2|3|4|5|6|7|8|9",
    "Email Address": "@", "E.164 Phone Number": "+", "IPv6 Address": ":", "MAC Address": ":", "Bearer Token": "bearer", "JWT Token": "eyj", "Private Key": "-----begin", "Generic API Key": "api", "Database Connection String": "://",
    "Ethereum Address": "0x", "Bitcoin Address (Bech32)": "bc1", "URL with Password": "://", "URL with Token": "://", "GPS Coordinates": ",", "AWS Access Key": "ia", "Google API Key": "aiza", "GitHub Token (Classic)": "ghp", "GitHub OAuth Token": "gho",
    "NPM Token": "npm", "Stripe Secret Key": "live", "Stripe Publishable Key": "live", "Slack Bot Token": "xoxb", "Slack Webhook": "hooks.slack", "SendGrid API Key": "sg.", "FIGI": "bbg", "Track 2 Data": "=",
    "Ticker Symbol": "$", "GPS DMS": "°", "EDU Email": ".edu", "TLP:WHITE": "tlp:", "AWS Secret Key": "aws|secret", "GitHub Token (Fine-Grained)": "github", "PyPI Token": "pypi", "Slack User Token": "xox", "Mailgun API Key": "key", "IDFA/IDFV": "-|0|1|2|3|4|5|6|7|8|9",
    "TLP:RED": "tlp:", "TLP:AMBER+STRICT": "tlp:", "TLP:AMBER": "tlp:", "TLP:GREEN": "tlp:", "TLP:CLEAR": "tlp:",
}


@lru_cache(maxsize=1 << 14)
def digit_run(regex: str) -> int:
    """A number of digits in a row that every match has; 0 where that isn't plain from the expression."""
    plain = re.sub(r"\(\?:[^()]*\)(?:\?|\*|\{0,\d*\})", "", regex)
    runs = [int(n) for n in re.findall(r"\[0-9\]\{(\d+)", plain)]
    return 0 if not runs else min(runs) if "|" in plain else max(runs)


def could(node, digit: bool) -> bool:
    """Whether a parsed expression consists of ASCII letters and digits only (``digit`` false), or matches some string without a digit."""
    kind, value = node
    name = str(kind)
    if name == "LITERAL":
        c = chr(value)
        return (c.isascii() and c.isalnum()) if not digit else not c.isdigit()
    if name == "IN":
        parts = [chr(x) for k, v in value if str(k) in ("LITERAL", "RANGE") for x in ((v,) if str(k) == "LITERAL" else v)]
        plain = all(str(k) in ("LITERAL", "RANGE") for k, _ in value) and all(c.isascii() and c.isalnum() for c in parts)
        return plain if not digit else not all(c.isdigit() for c in parts)
    if name == "MAX_REPEAT":
        least, _, inner = value
        return (digit and least == 0) or all(could(n, digit) for n in inner)
    if name == "SUBPATTERN":
        return all(could(n, digit) for n in value[-1])
    if name == "BRANCH":
        return (any if digit else all)(all(could(n, digit) for n in way) for way in value[1])
    return False


@lru_cache(maxsize=1 << 14)
def whole_token(regex: str) -> tuple[int, int] | None:
    """(least, most) length of an expression that always matches a whole run of letters and digits with a digit in it, else None."""
    if not (regex.startswith(r"\b") and regex.endswith(r"\b")):
        return None
    inner = list(sre_parse(regex[2:-2]))
    if not inner or not all(could(n, False) for n in inner) or all(could(n, True) for n in inner):
        return None
    least, most = sre_parse(regex).getwidth()
    return int(least), int(most)


compiled = lru_cache(maxsize=1 << 14)(re.compile)


class Guarded:
    """An expression with what a text needs to have for it."""

    def __init__(self, p: Pattern) -> None:
        self.pattern = p
        self.needs = tuple(NEEDS.get(p.sub_category, "").split("|"))
        self.run, self.wide = RUNS.get(p.sub_category, digit_run(p.regex)), WIDE.get(p.sub_category, 0)
        self.token = whole_token(p.regex)
        self.check = CHECKS.get(p.sub_category)

    @cached_property
    def expression(self) -> re.Pattern:
        return compiled(self.pattern.regex)


TOKEN = re.compile(r"\b[^\W\d]*+\d\w*+")
DIGIT_RUN = re.compile("[0-9]+")
#: Digits in a row of every match, where the expression doesn't tell; least runs of letters and digits of expressions that may have no digit.
RUNS = {"US Phone Number": 6, "UK Phone Number": 8, "GPS Coordinates": 3, "Hong Kong ID": 6}
WIDE = {"VIN": 17, "Litecoin Address": 27, "Ripple Address": 25, "Bitcoin Cash Address": 42, "MEID": 14, "Twilio API Key": 34}
WIDE_RUN = re.compile(r"\w{14,}")


@dataclass(slots=True)
class Match:
    start: int
    end: int
    order: int
    confidence: float
    guarded: Guarded
    context: bool
    text: str


def two_places(x: float) -> float:
    return math.floor(x * 100 + 0.5) / 100


def better(m: Match, last: Match) -> bool:
    """Whether a match replaces an overlapping one: higher confidence, then required context, specificity, length."""
    if abs(m.confidence - last.confidence) >= 2.220446049250313e-16:
        return m.confidence > last.confidence
    p, q = m.guarded.pattern, last.guarded.pattern
    gates = (p.context_required and m.context), (q.context_required and last.context)
    if gates[0] != gates[1]:
        return gates[0]
    if p.specificity != q.specificity:
        return p.specificity > q.specificity
    return m.end - m.start > last.end - last.start


def resolve(matches: list[Match]) -> list[Match]:
    """Overlaps resolved in one pass over the matches in order of their places: each is compared with the last kept one only."""
    kept: list[Match] = []
    for m in sorted(matches, key=lambda m: (m.start, -m.end, m.order)):
        if kept and m.start < kept[-1].end:
            if better(m, kept[-1]):
                kept[-1] = m
        else:
            kept.append(m)
    return kept


class Engine:
    """A catalogue and a configuration, prepared for texts."""

    def __init__(self, config: ScanConfig) -> None:
        self.config = config
        patterns = config.active()
        self.keywords = Keywords(patterns)
        every = [Guarded(p) for p in patterns]
        self.place = {g.pattern.pattern_id: i for i, g in enumerate(every)}
        self.every = every
        self.always = [i for i, g in enumerate(every) if g.pattern.always_run]
        self.second = [i for i in self.always if not every[i].pattern.context_required]
        self.by_length = {False: self.lengths(self.always), True: self.lengths(self.second)}
        self.free = {False: [i for i in self.always if not every[i].token], True: [i for i in self.second if not every[i].token]}

    def lengths(self, chosen: list[int]) -> dict[int, list[int]]:
        """Expressions of whole runs by the length of the run."""
        out: dict[int, list[int]] = {}
        for i in chosen:
            if self.every[i].token:
                for n in range(self.every[i].token[0], min(self.every[i].token[1], LONGEST) + 1):
                    out.setdefault(n, []).append(i)
        return out

    def matches(self, norm: str, low_text: str, hits: dict[int, list[int]], alt: bool) -> tuple[list[tuple[int, int, int, str]], bool]:
        """(expression, start, end, text) of all checked matches by catalogue order, and whether a bound cut some off."""
        every, cut, bound = self.every, False, self.config.per_pattern
        tokens = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(norm)]
        found: list[tuple[int, int, int, str]] = []
        by_length = self.by_length[alt]
        asked = sorted({self.place[p] for p in hits if not every[self.place[p]].pattern.always_run}) if not alt else []
        keyed = [i for i in asked if every[i].token]
        longest = 0
        for a, b, s in tokens:
            n = b - a
            for i in by_length.get(n, ()):
                if every[i].expression.fullmatch(s) and ((check := every[i].check) is None or check(s)):
                    found.append((i, a, b, s))
            for i in keyed:
                low, high = every[i].token
                if low <= n <= high and every[i].expression.fullmatch(s) and ((check := every[i].check) is None or check(s)):
                    found.append((i, a, b, s))
            if n > longest:
                longest = max(longest, max(map(len, DIGIT_RUN.findall(s)), default=0))
        widest = max(map(len, WIDE_RUN.findall(norm)), default=0)
        for i in [*self.free[alt], *(i for i in asked if not every[i].token)]:
            g = every[i]
            if g.run > longest or g.wide > widest:
                continue
            for need in g.needs:
                if need in low_text:
                    break
            else:
                continue
            for m in g.expression.finditer(norm):
                a, b = m.span()
                if a != b and (g.check is None or g.check(m.group())):
                    found.append((i, a, b, m.group()))
        found.sort()
        if len(found) > bound:
            kept, counts = [], {}
            for f in found:
                counts[f[0]] = counts.get(f[0], 0) + 1
                if counts[f[0]] <= bound:
                    kept.append(f)
            cut, found = len(kept) < len(found), kept
        return found, cut

    def scored(self, g: Guarded, context: bool, alt: bool) -> float | None:
        """Confidence of a match, None where a gate holds it back."""
        p, config = g.pattern, self.config
        if not alt and not context and (p.context_required or config.require_context):
            return None
        score = two_places(min(p.specificity + 0.20, 1.0) if context else p.specificity)
        return None if score < config.min_confidence else score * 0.9 if alt else score

    def scan(self, whole: str, other_readings: bool = True) -> tuple[list[tuple], bool]:
        """(findings, truncated) of one text."""
        config = self.config
        size = len(whole) if whole.isascii() else len(whole.encode("utf-8", "surrogatepass"))
        if not 1 <= size <= config.most_bytes:
            return [], False
        norm, places = normalize(whole)
        low = norm.lower() if norm.isascii() else norm.translate(ASCII_LOWER)
        hits = self.keywords.hits(low)
        found, cut = self.matches(norm, low, hits, False)
        raw = whole.encode("utf-8", "surrogatepass") if found else b""
        out: list[Match] = []
        for i, a, b, s in found:
            g = self.every[i]
            near = hits.get(g.pattern.pattern_id)
            context = False
            if near:
                k = bisect.bisect_left(near, a - g.pattern.distance)
                context = k < len(near) and near[k] < b + g.pattern.distance
            score = self.scored(g, context, False)
            if score is not None:
                start, end = places[a], places[b] if b < len(places) else size
                out.append(Match(start, end, len(out), score, g, context, raw[start:end].decode("utf-8", "replace")))
        if other_readings and len(out) < 3 and len(found) < 3 and size < config.alternative_bytes:
            for other in alternatives(norm):
                other = normalize(other, places=False)[0]
                if other == norm:
                    continue
                more, more_cut = self.matches(other, other.lower() if other.isascii() else other.translate(ASCII_LOWER), {}, True)
                cut |= more_cut
                for i, _, _, s in more:
                    score = self.scored(self.every[i], False, True)
                    if score is not None:
                        out.append(Match(0, size, len(out), score, self.every[i], False, s))
        if len(out) > config.max_matches:
            cut, out = True, out[: config.max_matches]
        kept = resolve(out) if config.deduplicate else out
        rows = [(m.guarded.pattern.category, m.guarded.pattern.sub_category, m.text, m.start, m.end, m.context, m.guarded.pattern.context_required, m.confidence, m.guarded.pattern.specificity) for m in kept]
        if config.disabled:
            rows = [r for r in rows if (r[0], r[1]) not in config.disabled]
        for _, validator in config.validators:
            rows = [r for r in rows if validator(r[1], r[2])]
        if config.ignore_marker and config.ignore_marker in whole:
            rows = [r for r in rows if not ignored(raw or whole.encode("utf-8", "surrogatepass"), r[3], config.ignore_marker)]
        return rows, cut


def ignored(raw: bytes, start: int, marker: str) -> bool:
    """Whether the line in which a finding begins has the marker."""
    a, b = raw.rfind(b"\n", 0, start) + 1, raw.find(b"\n", start)
    return marker.encode() in raw[a : b if b >= 0 else len(raw)]


@lru_cache(maxsize=8)
def prepared(config: ScanConfig) -> Engine:
    """The engine of a configuration, once per worker."""
    return Engine(config)


FINDING = "category string, sub_category string, text string, span_start bigint, span_end bigint, has_context boolean, context_required boolean, confidence double, specificity double"
FIELDS = [f.split(" ")[0] for f in FINDING.split(", ")]


def stage(config: ScanConfig):
    """Partition function: (doc_id, text) to (doc_id, scan_truncated, findings)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = prepared(config)
        for frame in frames:
            done = [engine.scan(t) if t else ([], False) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "scan_truncated": [cut for _, cut in done], "findings": [[dict(zip(FIELDS, r)) for r in rows] for rows, _ in done]})

    return run


def scan_documents(documents: DataFrame, config: ScanConfig | None = None, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per row of the input: doc_id, scan_truncated, findings (an array, empty for clean texts)."""
    rows = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(column).alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(stage(config or ScanConfig()), f"doc_id {kind}, scan_truncated boolean, findings array<struct<{FINDING.replace(' ', ':').replace(',:', ', ')}>>")


def scan(documents: DataFrame, config: ScanConfig | None = None, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """Findings: doc_id, category, sub_category, text, span_start, span_end, has_context, context_required, confidence, specificity."""
    rows = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(column).alias("text")).where("text is not null and text <> ''"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    config = config or ScanConfig()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = prepared(config)
        for frame in frames:
            made = [(d, *r) for d, t in zip(frame["doc_id"], frame["text"]) for r in engine.scan(t)[0]]
            yield pd.DataFrame(made, columns=["doc_id", *FIELDS])

    return rows.mapInPandas(run, f"doc_id {kind}, {FINDING}")


def statuses(documents: DataFrame, doc_id: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, status): ok, empty or too_large."""
    n = F.octet_length(F.coalesce(F.col(column), F.lit("")))
    return documents.select(F.col(doc_id).alias("doc_id"), F.when(n == 0, "empty").when(n > MOST_BYTES, "too_large").otherwise("ok").alias("status"))


#: Words near which a token may be a secret, and what separates tokens.
ENTROPY_WORDS = "secret key token password passwd pwd auth credential bearer connection_string conn_str database_url jeton identifiant contraseña contrasena credencial passwort kennwort zugangsdaten anmeldedaten credenziali senha".split()
ENTROPY_TOKEN = r"""[^\s,;'"()\[\]{}=:]{16,256}"""


def high_entropy_tokens(documents: DataFrame, doc_id: str = "doc_id", column: str = "text", least: float = 4.5, gated: bool = True) -> DataFrame:
    """(doc_id, token, entropy, confidence) of long mixed tokens; gated: a secret's word within 80 characters before or after."""
    t = F.explode(F.regexp_extract_all(F.col(column), F.lit(f"({ENTROPY_TOKEN})")))
    tokens = documents.select(F.col(doc_id).alias("doc_id"), F.lower(column).alias("low"), t.alias("token"))
    mixed = ~F.col("token").rlike(r"^[0-9.-]+$") & ~F.col("token").rlike(r"^[a-z]+$")
    scored = tokens.where(mixed).withColumn("entropy", text.char_entropy(F.col("token"))).where(F.col("entropy") >= least)
    if gated:
        place = F.expr("locate(lower(token), low)")
        window = F.substring(F.col("low"), F.greatest(place - 80, F.lit(1)), F.length("token") + 160)
        scored = scored.where(window.rlike("|".join(ENTROPY_WORDS)))
    return scored.select("doc_id", "token", "entropy", scoring.entropy_confidence(F.col("entropy")).alias("confidence")).distinct()
