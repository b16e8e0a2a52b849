"""Secrets in documents: candidate strings judged by a random forest trained on labelled findings.

Candidates are the values in tokens that hold a digit, a sign of assignment, a long run of capitals or the beginning of an issued
key: every issued key, assigned value, quoted string, URL parameter and field; whatever is assigned to a name with a secret word;
and the word after a secret word. They never overlap. Each is described by its length and character
classes, transitions between characters, coverage by dictionary words, its likeness to paths, addresses and numbers, and
the words around it. The forest removes false positives such as hashes, identifiers, placeholders and phone numbers.

Documents are scanned whole, in the tasks that read them; nothing is shuffled, and the model is a few hundred kilobytes.
"""

from __future__ import annotations

import dataclasses
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "<secret>"
#: characters of a candidate that no name is assigned to; assigned values may have any length
LEAST = 8
BEFORE, AFTER = 60, 40

#: what a token worth a look holds; other words are passed over quickly
_SIGN = re.compile(r"[0-9=:]|[A-Z]{12}|gh[pousr]_|xox[abprs]-|AIza|sk_live_|eyJ")
_REST = re.compile(r"\S*")
_ASSIGNED = re.compile(r"^[\"'({\[<]*([A-Za-z][\w.\-]{1,40})[\"']?(?::=|=>|[=:])[\"'({\[<]*(.*)$", re.S)
#: a word that may belong to a secret's name, up to the sign of assignment
_NAMED = re.compile(r"(?:password|passwd|pwd|passphrase|secret|token|key|access|credential|auth|bearer|private)[\w.\-]{0,200}[\"']?[ \t]{0,8}(?::=|=>|[=:])[ \t]{0,8}", re.I)
#: a secret word, and what may stand between it and the secret where nothing is assigned
_SPOKEN = re.compile(r"(?<![A-Za-z])(password|passwd|pwd|passphrase|secret|token|apikey|key|credentials?|auth|bearer)\s{1,8}(?:(is|was|are|ist|est|es|->|-)\s{1,8})?(?=\S)", re.I)
_VALUE = re.compile(r"\"([^\"\n]+)\"|'([^'\n]+)'|(\S+)")
_NAME_END = re.compile(r"[A-Za-z][\w.\-]{0,80}$")
_HEAD = re.compile(r"([A-Za-z][\w.\-]{0,40})[\"']?(?::=|=>|[=:])(?!//)")
#: where a value ends if another assignment follows, and where fields end
_NEXT = re.compile(r"[,;&|?#{\[(][\"']?(?=[A-Za-z][\w.\-]{0,40}[\"']?(?::=|=>|[=:]))")
_FIELD = re.compile(r"[^,;|\"'`()\[\]{}<>]+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_LOGIN = re.compile(r"://[^/@:\s]*:([^/@\s]+)@")
_EDGES = "\"'`()[]{}<>,;."
_WORDS = re.compile(r"[^\W\d_]+")
#: fixed values: words that stand at secrets, and words that stand at harmless strings
SECRET_WORDS = frozenset("password passwd pwd passphrase secret token apikey api key accesskey access credential credentials auth bearer private".split())
BENIGN_WORDS = frozenset("example sample dummy placeholder test sha commit checksum md5 digest hash uuid guid version id ref isbn phone tel call order invoice serial build revision page card fax mail".split())
DICTIONARY = frozenset(
    "the and for you that with this from have not are was but all can your one our out about time get use new more when what some them than then now only come over think also back after work first well even want because any these give day most secret password token key user name change example sample test data file path home version release admin login server local config default value string index item page list main http https www com org net html".split()
)
#: fixed values: beginnings of issued keys
_ISSUED = re.compile(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[\w-]{30,}$|^sk_live_[A-Za-z0-9]{16,}$|^eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*$")
_ISSUED_IN = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{30,}|sk_live_[A-Za-z0-9]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*)")
_UUID = re.compile(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", re.I)
_NUMBERS = re.compile(r"^[+\d()./:\-,% ]+$")


@dataclasses.dataclass(frozen=True)
class Candidate:
    start: int
    value: str
    name: str
    before: str
    after: str
    #: how a secret word leads to the value: 0 not at all, 1 it stands before it, 2 with a word between, 3 by assignment
    joined: int = 0


def _words_of(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)}


def _fields(s: str, at: int, name: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of the values in `s`, which has no assignment: its issued keys, and what is left between marks."""
    rest = 0
    for m in (*_ISSUED_IN.finditer(s), None):
        end = m.start() if m else len(s)
        part = s[rest:end]
        # a value stays whole unless it is a quoted string with more after it, or one field of several
        if name and not (rest or m) and not _QUOTED.match(part) or "://" in part:
            yield at + rest, at + end, name
        else:
            for f in _FIELD.finditer(part):
                yield at + rest + f.start(), at + rest + f.end(), name
        if m:
            yield at + m.start(), at + m.end(), name
            rest = m.end()


def _values(token: str, at: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of every value in a token."""
    if m := _LOGIN.search(token):
        yield at + m.start(1), at + m.end(1), "password"
        token, at = token[m.end() :], at + m.end()
    marks = [0, *(m.end() for m in _NEXT.finditer(token)), len(token)]
    for first, last in zip(marks, marks[1:]):
        part = token[first:last]
        lead = len(part) - len(part.lstrip("\"'({[<"))
        if a := _HEAD.match(part, lead):
            yield from _fields(part[a.end() :], at + first + a.end(), a[1])
        else:
            yield from _fields(part, at + first, "")


def _assigned(text: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of every value, of whatever characters, that follows a name with a secret word and ':' or '='."""
    out, seen = [], 0
    while m := _NAMED.search(text, seen):
        seen = m.end()
        head = re.match(r"[\w.\-]+", m[0])[0]
        name = _NAME_END.search(text[max(0, m.start() - 40) : m.start()] + head)
        v = _VALUE.match(text, m.end())
        if not name or not v or not _words_of(name[0]) & SECRET_WORDS or v[0].lower() in SECRET_WORDS:
            continue
        k = v.lastindex
        if k < 3:
            out.append((v.start(k), v.end(k), name[0]))
            seen = v.end()
            continue
        value = v[3]
        cut = _NEXT.search(value)
        parts = list(_fields(value[: cut.start()] if cut else value, v.start(3), name[0]))
        out += parts
        seen = max(seen, parts[-1][1] if parts else 0)
    return out


def _spoken(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, name, joined) of the word or quoted string after a secret word, where no span that is taken meets it."""
    k = 0
    for m in _SPOKEN.finditer(text):
        v = _VALUE.match(text, m.end())
        start, end = v.span(v.lastindex)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        # a word with a sign is split into its values by itself
        if not (k < len(taken) and taken[k][0] < end) and not (v[3] and _SIGN.search(v[3])):
            yield start, end, m[1], 2 if m[2] else 1


def candidates(text: str) -> list[Candidate]:
    """Candidate strings with their start (in code points) and what stands around them."""
    spans = _assigned(text)
    spoken = list(_spoken(text, spans))
    how = {start: joined for start, _, _, joined in spoken}
    assigned = {start for start, _, _ in spans}
    spans = sorted(spans + [(a, b, name) for a, b, name, _ in spoken])
    # what the rest of a token gives, where nothing is assigned to a secret's name
    taken, k, seen, more = spans, 0, 0, []
    while m := _SIGN.search(text, seen):
        first = m.start()
        while first > 0 and not text[first - 1].isspace():
            first -= 1
        last = seen = _REST.match(text, m.end()).end()
        while k < len(taken) and taken[k][1] <= first:
            k += 1
        j, at = k, first
        while j < len(taken) and taken[j][0] < last:
            if at < taken[j][0]:
                more += _values(text[at : taken[j][0]], at)
            at = max(at, taken[j][1])
            j += 1
        if at < last:
            more += _values(text[at:last], at)
    out = []
    for start, end, name in sorted(spans + more):
        value = text[start:end]
        left = len(value) - len(value.lstrip(_EDGES))
        value = value.strip(_EDGES)
        if len(value) >= (1 if start in assigned else LEAST):
            first = start
            while first > max(0, start - 200) and not text[first - 1].isspace():
                first -= 1
            last = _REST.match(text, end).end() if end - start < 4000 else end
            out.append(Candidate(start + left, value, name, text[max(0, first - BEFORE) : first], text[last : last + AFTER], how.get(start, 3 if name else 0)))
    return out


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def _covered(s: str) -> float:
    """Share of letters that belong to dictionary words of three letters or more, longest first from the left."""
    low, n, i, hit = s.lower(), sum(c.isalpha() for c in s), 0, 0
    while i < len(low):
        for k in range(min(10, len(low) - i), 2, -1):
            if low[i : i + k] in DICTIONARY:
                hit, i = hit + k, i + k
                break
        else:
            i += 1
    return hit / n if n else 0.0


_VOWELS = frozenset("aeiouäöüáéíóúàèêâîôyAEIOU")


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3


FEATURES = ["length", "digits", "upper", "lower", "symbols", "entropy", "changes", "letter_digit", "vowel_rhythm", "covered", "slashes", "dots", "at", "numbers", "named_secret", "near_secret", "near_benign", "named", "quoted", "hex", "uuid", "issued", "longest_letters", "joined"]


def features(c: Candidate) -> list[float]:
    s, n = c.value, len(c.value)
    kinds = [_kind(x) for x in s]
    letters = [x in _VOWELS for x in s if x.isalpha()]
    around = [w.lower() for w in _WORDS.findall(c.before)[-3:] + _WORDS.findall(c.after)[:2]]
    names = _words_of(c.name)
    runs = [len(x) for x in _WORDS.findall(s)]
    return [
        n, kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n, _entropy(s),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, sum({a, b} in ({0, 1}, {0, 2}) for a, b in zip(kinds, kinds[1:])) / n,
        sum(a != b for a, b in zip(letters, letters[1:])) / max(1, len(letters)), _covered(s),
        s.count("/") + s.count("\\"), s.count("."), float("@" in s), float(bool(_NUMBERS.match(s))), float(bool(names & SECRET_WORDS)),
        float(any(w in SECRET_WORDS for w in around)), float(any(w in BENIGN_WORDS for w in (*around, *names))), float(bool(c.name)),
        float(c.before.rstrip()[-1:] in "=:" and bool(c.before.strip())), float(all(x in "0123456789abcdefABCDEF" for x in s)), float(bool(_UUID.match(s))), float(bool(_ISSUED.match(s))), max(runs, default=0), c.joined,
    ]


# --- labelled findings ------------------------------------------------------------------------------------------------


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, int]]:
    """(line, 1 if the candidate in it is a secret): `n` findings as a reviewer would have labelled them, drawn from a seed.

    Where labelled findings of one's own exist, pass those to `train` instead.
    """
    r = random.Random(seed)
    filler = ["er", "tion", "and", "sch", "ung", "que", "ent", "las", "mo", "ter", "in", "os"]
    prose = lambda k: " ".join("".join(r.choices(filler, k=r.randint(1, 4))) for _ in range(k))
    draw = lambda alphabet, a, b: "".join(r.choices(alphabet, k=r.randint(a, b)))
    hexes, digits = "0123456789abcdef", "0123456789"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed = upper + upper.lower() + digits
    keys = ["password", "passwd", "pwd", "secret", "token", "api_key", "apiKey", "access_key", "auth_token", "client_secret", "DB_PASSWORD"]
    spoken = ["password", "passphrase", "secret", "token", "key", "Bearer", "the api key", "Authorization: Bearer"]
    with_digit = lambda s: s if any(x.isdigit() for x in s) else s[:-1] + r.choice(digits)
    secrets = [
        lambda: f"AKIA{draw(r.choice([upper, upper + digits]), 16, 16)}",
        lambda: f"{r.choice(keys)}={with_digit(draw(r.choice([hexes, mixed]), 10, 40))}",
        lambda: f'{r.choice(keys)} = "{with_digit(draw(r.choice([hexes, mixed]), 16, 44))}"',
        lambda: f"{r.choice(keys)}: {with_digit(draw(mixed + '!$%&+-_', 10, 32))}",
        lambda: f"ghp_{draw(mixed, 36, 36)}",
        lambda: f"xoxb-{draw(digits, 10, 12)}-{draw(mixed, 20, 24)}",
        lambda: f"AIza{draw(mixed + '_-', 35, 35)}",
        lambda: f"sk_live_{draw(mixed, 24, 32)}",
        lambda: f"eyJ{draw(mixed, 20, 40)}.eyJ{draw(mixed, 30, 60)}.{draw(mixed, 30, 43)}",
        lambda: f"Bearer {with_digit(draw(mixed, 24, 48))}",
        lambda: f"{r.choice(spoken)} {draw(r.choice([mixed, upper + upper.lower()]), 20, 40)}",
        lambda: f"{r.choice(spoken[:4])} {r.choice(['is', 'was', '->'])} {'-'.join(prose(1) for _ in range(r.randint(3, 5)))}",
        lambda: f"{r.choice(keys)}{r.choice(['=', ': ', ' = '])}{draw(upper.lower(), 3, 7)}{r.choice(['', r.choice('!$%&+')])}{draw(digits, 1, 4)}",
        lambda: f'{r.choice(keys)} = "{"-".join(prose(1) for _ in range(3))}-{prose(1)}"',
        lambda: f"{r.choice(keys)}: {prose(1).capitalize()}{r.choice('!$%&+')}{prose(2).replace(' ', '').capitalize()}{r.choice(filler)}",
    ]
    harmless = [
        lambda: f"{r.choice(['commit', 'sha', 'checksum', 'md5', 'digest', 'revision'])} {draw(hexes, 32, 40)}",
        lambda: f"{r.choice(['id', 'uuid', 'ref'])} " + "-".join(draw(hexes, k, k) for k in (8, 4, 4, 4, 12)),
        lambda: f"{r.choice(keys)}={r.choice(['changeme', 'example1', 'your_password', 'xxxxxxxx', 'placeholder', '<password>', '********', 'password123example'])}",
        lambda: f"+{draw(digits, 1, 2)} ({draw(digits, 3, 3)}) {draw(digits, 3, 3)}-{draw(digits, 4, 4)}",
        lambda: draw(digits, 8, 19),
        lambda: ".".join(draw(digits, 1, 3) for _ in range(4)),
        lambda: f"{draw(upper.lower(), 3, 8)}.{draw(digits, 1, 3)}@{draw(upper.lower(), 3, 8)}{draw(digits, 0, 2)}.example.com",
        lambda: f"https://www.{draw(upper.lower(), 4, 9)}.com/{draw(upper.lower(), 3, 8)}/{draw(digits, 3, 6)}.html?page={draw(digits, 1, 2)}",
        lambda: f"/usr/{draw(upper.lower(), 3, 8)}/{draw(upper.lower(), 3, 8)}{draw(digits, 1, 2)}/{draw(upper.lower(), 3, 6)}.py",
        lambda: f"20{draw(digits, 2, 2)}-0{draw('123456789', 1, 1)}-1{draw(digits, 1, 1)}T{draw(digits, 2, 2)}:{draw(digits, 2, 2)}:{draw(digits, 2, 2)}",
        lambda: f"version={r.choice('123456789')}.{draw(digits, 1, 2)}.{draw(digits, 1, 4)}-release",
        lambda: f"{prose(1)}:{prose(1).replace(' ', '')}{prose(1)}",
        lambda: f"{prose(1)}{prose(1)}{draw(digits, 1, 2)}",
        lambda: f"{r.choice(keys)}: {prose(3).replace(' ', '')}",
        lambda: f"{r.choice(spoken)} {r.choice(['', 'is ', 'was '])}{prose(3).replace(' ', '')}",
        lambda: f"{r.choice(spoken)} {r.choice(['', 'is '])}{prose(1)}{r.choice(['-', '/', ''])}{prose(2).replace(' ', '')}er{r.choice(['', ',', '.'])}",
        lambda: f"{r.choice(spoken)} {r.choice(['', 'is '])}{'-'.join(prose(1) for _ in range(2))}-{r.choice(['based', 'free', 'like', 'time'])}",
        lambda: f"{r.choice([*keys, 'key', 'access'])}{r.choice(['=', ': ', ' = '])}{r.choice([prose(1), prose(1), draw(digits, 1, 3), r.choice(['yes', 'none', 'null', 'true', 'required', 'public', 'N/A', '...', '-'])])}",
        lambda: f"order {draw(upper, 2, 3)}-{draw(digits, 5, 8)}",
        lambda: f"{r.choice(['width', 'page', 'name', 'class', 'size'])}={prose(1)}{prose(1)}{draw(digits, 0, 2)}",
        lambda: f"{prose(6).replace(' ', '')[: r.randint(12, 24)].upper()}{r.choice(['', '!!', ',', '.'])}",
        lambda: f"{r.choice(upper)}{prose(1)}-{draw(digits, 4, 4)}-{draw(digits, 3, 3)}",
    ]
    out = []
    while len(out) < n:
        y = len(out) % 2
        line = f"{prose(r.randint(0, 6))} {r.choice(secrets if y else harmless)()} {prose(r.randint(0, 6))}".strip()
        if candidates(line):
            out.append((line, y))
    return out


# --- the forest -------------------------------------------------------------------------------------------------------


@dataclasses.dataclass
class Forest:
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that a candidate reaches."""
        total = np.zeros(len(x))
        for feature, cut, child, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go = np.where(x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at], child[at], child[at] + 1)
                at = np.where(inner, go, at)
            total += value[at]
        return total / max(1, len(self.trees))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 4, seed: int = 5) -> Forest:
    """Bootstrap samples, a random third of the features at each node, splits by Gini impurity at up to 24 quantiles."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        feature, cut, child, value = [-1], [0.0], [0], [0.0]
        todo = [(0, rng.integers(0, len(x), len(x)), 0)]
        while todo:
            node, rows, level = todo.pop()
            p = y[rows].mean()
            value[node] = p
            if level >= depth or len(rows) < 2 * least or p in (0, 1):
                continue
            best = (p * (1 - p) * len(rows) - 1e-9, None, None)
            for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
                v = x[rows, f]
                for c in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 24))):
                    left = v <= c
                    k = left.sum()
                    if least <= k <= len(rows) - least:
                        a, b = y[rows[left]].mean(), y[rows[~left]].mean()
                        g = a * (1 - a) * k + b * (1 - b) * (len(rows) - k)
                        if g < best[0]:
                            best = (g, f, c)
            if best[1] is None:
                continue
            feature[node], cut[node], child[node] = int(best[1]), float(best[2]), len(feature)
            left = x[rows, best[1]] <= best[2]
            for part in (rows[left], rows[~left]):
                todo.append((len(feature), part, level + 1))
                for column, empty in ((feature, -1), (cut, 0.0), (child, 0), (value, 0.0)):
                    column.append(empty)
        out.append((np.array(feature), np.array(cut), np.array(child), np.array(value)))
    return Forest(out)


def train(findings: list[tuple[str, int]] | None = None) -> Forest:
    """A forest from labelled lines; of several candidates in a line the last one counts."""
    findings = labelled_findings() if findings is None else findings
    rows = [(features(c[-1]), y) for line, y in findings if (c := candidates(line))]
    if not rows:
        return Forest([])
    return grow(np.array([x for x, _ in rows]), np.array([y for _, y in rows], float))


# --- scanning ---------------------------------------------------------------------------------------------------------

FOUND = "doc_id long, start long, length long, name string, score double"


def _judged(texts: list[str | None], forest: Forest, threshold: float) -> list[list[tuple[Candidate, float]]]:
    each = [candidates(t) if t else [] for t in texts]
    flat = [c for cs in each for c in cs]
    scores = forest.scores(np.array([features(c) for c in flat])) if flat else np.zeros(0)
    out, at = [], 0
    for cs in each:
        out.append([(c, float(s)) for c, s in zip(cs, scores[at : at + len(cs)]) if s >= threshold])
        at += len(cs)
    return out


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """doc_id, start and length (code points), name of what is assigned and score of every secret.

    Null and empty texts have none; repeated rows are scanned each for itself, ids may be null; an empty table gives an empty
    result. Texts of any length are scanned whole, in one task each. A score equal to the threshold counts as a secret. Other
    columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for k in range(0, b.num_rows, 500):
                rows = []
                for doc, hits in zip(ids[k:], _judged(b.column(1)[k : k + 500].to_pylist(), shared.value, threshold)):
                    rows += [(doc, c.start, len(c.value), c.name, s) for c, s in hits]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "start", "length", "name", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def redact(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """The same rows and columns with every secret in `text` replaced by a mark; `n_chars`, where present, is counted anew.

    Null texts stay null and keep their n_chars, empty ones stay empty; repeated rows and null ids are kept, each masked for
    itself; an empty table gives an empty result. Other columns, of whatever name, pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    schema = docs.schema
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(where).to_pylist()
            for k in range(0, b.num_rows, 500):
                for i, hits in enumerate(_judged(texts[k : k + 500], shared.value, threshold), k):
                    for c, _ in reversed(hits):
                        texts[i] = texts[i][: c.start] + MARK + texts[i][c.start + len(c.value) :]
            yield pa.RecordBatch.from_arrays([*b.columns[:where], pa.array(texts, b.schema.field(where).type), *b.columns[where + 1 :]], b.schema.names)

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(schema["n_chars"].dataType), F.col("n_chars")))
    return out
