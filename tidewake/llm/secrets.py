"""Operator 5, secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least 12 token characters that holds a digit, or of at least 16 that holds upper case inside,
or the whole value, of any length and characters, that is assigned to a name such as password (up to its closing quote,
or unquoted to the next blank without a final full stop, comma or semicolon), or the password in a URL.

The forest (numpy, decision trees on bootstrap samples with random feature subsets) sees a candidate's length, the
likelihood of its character transitions, its dictionary coverage, the words before, after and inside it, its first
characters, and the path. Dictionary and transitions come from the words of the documents themselves, counted over all of
them (about the ``DICTIONARY`` most frequent are kept); what words, beginnings and paths say is learned, as log odds, from
the labelled findings: the caller's, or the seeded set that labelled_findings() makes by rule of the same dictionary.

Defined results: null and empty texts have no findings; equal texts have equal findings (with paths, equal texts and
paths); long texts and candidates are scanned whole; an empty table gives an empty result; candidates may lie in each
other, and secrets that overlap are one; other input columns, whatever their names, are ignored by scan() and kept by
remove_secrets().
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm.common import cut, map_texts, text_or_empty

RUN = re.compile(r"[A-Za-z0-9_\-+/]{8,}")
SECRET_NAME = r"(?i:passw(?:or)?d|passwd|pwd|secret|token|api_?key|auth|credential|private_?key|access_?key)[\"']?\s{0,3}"
ASSIGNED = re.compile(SECRET_NAME + r"[:=]{1,2}>?\s{0,3}[\"']?\Z")
NAME_BEFORE = re.compile(SECRET_NAME + r"\Z")
#: An assignment and its value, quoted or up to a blank; the password of a URL.
QUOTED = re.compile(r"""[:=]{1,2}>?\s{0,3}(?:"((?:\\.|[^"\\\n])+)"|'((?:\\.|[^'\\\n])+)')""")
UNQUOTED = re.compile(r"""[:=]{1,2}>?\s{0,3}["']?([^\s"'=:]\S*)""")
SEPARATOR = re.compile(r"[:=]{1,2}")
URL_PASSWORD = re.compile(r"://[^\s/?#:@]*:([^\s/?]+)@")
URL_USER = re.compile(r"://[^\s/?#:@]*:\Z")
PLACE = re.compile(r"https?:|www\.|[/\\@]\Z|\.\w{2,4}/")
#: Variables, calls and placeholders instead of a value.
CODE = re.compile(r"^[$<{%]|[\w.]\(|^(?:\w+\.)+\w+$|^[*x.]+$|^(?i:none|null|nil|true|false|undefined|password|secret|token)$")
WORD = re.compile(r"[A-Za-z]{2,}")
#: Words of the dictionary, the lengths they may have, and characters of context before and after a candidate.
DICTIONARY, LENGTHS, BEFORE, AFTER = 20_000, (3, 12), 80, 40
#: Without documents: parts of words that many European languages share.
COMMON = (
    "tion the er an ing re es ou le que ment eau sch ver heit ung ein co ci ra do as ie en th nd st ha or ll rr pf tz wh sh ai aux oi pa "
    "and for with from der die und les des del los por para con una est was are that this have not you all can"
).split()


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates of a whole text, in order; of two that start together the longer first."""
    out = set()
    for m in RUN.finditer(text):
        a, b = m.span()
        run = m.group()
        n = b - a
        digit = not run.isalpha() and any(c.isdigit() for c in run)
        if digit and n >= 12 or n >= 16 and not run.islower() and not run[1:].islower() or ASSIGNED.search(text, max(0, a - 40), a):
            out.add((a, b))
    # Assignments inside an unquoted value are candidates up to the next of them, so that their lengths add up to its own.
    end, inner = 0, -1
    for m in SEPARATOR.finditer(text):
        if not (name := NAME_BEFORE.search(text, max(0, m.start() - 20), m.start())):
            continue
        if inner >= 0:
            out.add((inner, min(end, max(inner, name.start()))))
            inner = -1
        if m.end() < end:
            if value := QUOTED.match(text, m.start()):
                out.add(value.span(value.lastindex))
            else:
                inner = m.end() + (text[m.end()] in "\"'>")
        elif value := QUOTED.match(text, m.start()):
            out.add(value.span(value.lastindex))
        elif value := UNQUOTED.match(text, m.start()):
            end = value.start(1) + len(value[1].rstrip(".,;"))
            out.add((value.start(1), end))
    if inner >= 0:
        out.add((inner, end))
    out.update(m.span(1) for m in URL_PASSWORD.finditer(text))
    return sorted((s for s in out if s[0] < s[1]), key=lambda s: (s[0], -s[1]))


def letters(text: str) -> np.ndarray:
    """0 to 25 for letters of either case, 26 for digits, 27 for letters beyond ASCII, 28 for all else."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    out = np.where((codes >= 97) & (codes <= 122), codes - 97, 28)
    out[(codes >= 48) & (codes <= 57)] = 26
    out[codes > 127] = 27
    return out


def tokens(text: str, a: int, b: int, path: str) -> dict[str, list[str]]:
    """Words around and inside a candidate, its first characters, and the words of the path."""
    low = lambda part: [w.lower() for w in WORD.findall(part)]
    before = low(text[max(0, a - BEFORE) : a])
    return {
        "last": before[-1:], "near": [*before[-3:-1], *[">" + w for w in low(text[b : b + AFTER])[:1]]],
        "start": [text[a : min(b, a + k)] for k in (2, 3, 4)], "inner": low(text[a:b]), "path": low(path),
    }


class Lexicon:
    """Of the words around candidates, log odds between secrets and the rest."""

    def __init__(self, rows: list[tuple[str, int, int, int, str]], least: int = 30):
        seen: dict[str, list[Counter]] = {}
        n = Counter(r[3] for r in rows)
        for text, a, b, label, path in rows:
            for kind, own in tokens(text, a, b, path).items():
                seen.setdefault(kind, [Counter(), Counter()])[label].update(set(own))
        odds = lambda p, q: math.log((p + 1) / (n[1] + 2)) - math.log((q + 1) / (n[0] + 2))
        self.odds = {kind: {w: odds(c[1][w], c[0][w]) for w in c[0] | c[1] if c[0][w] + c[1][w] >= least} for kind, c in seen.items()}

    def scores(self, text: str, a: int, b: int, path: str) -> list[float]:
        return [sum(self.odds.get(kind, {}).get(w, 0.0) for w in set(own)) for kind, own in tokens(text, a, b, path).items()]


class Dictionary:
    def __init__(self, words: list[str]):
        self.words = sorted(set(words))
        self.set, self.longest = frozenset(self.words), max(map(len, self.words), default=0)
        counts = np.ones((29, 29))
        for w in self.words:
            x = letters(w)
            np.add.at(counts, (x[:-1], x[1:]), 1)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))

    def coverage(self, run: str) -> float:
        """The part of the run that words of three letters and more cover, the longest first."""
        low, at, covered = run.lower(), 0, 0
        while at < len(low):
            n = next((k for k in range(min(self.longest, len(low) - at), 2, -1) if low[at : at + k] in self.set), 0)
            covered += n
            at += n or 1
        return covered / len(low)

    def likelihood(self, run: str) -> float:
        """Mean log probability of its character transitions."""
        x = letters(run)
        return float(self.log[x[:-1], x[1:]].mean()) if len(x) > 1 else 0.0


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of all texts, counted whole: at most size, without those as frequent as a word beyond it.

    The count from which a word belongs is found from how many words have each count, in ranges that grow by a
    hundredth, so that no more than the words themselves reaches the driver."""
    words = docs.select(F.explode(F.split(F.lower(text_or_empty(text)), r"[^\p{L}]+")).alias("word")).filter(F.length("word").between(*LENGTHS))
    counts = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    ranges = counts.groupBy(F.floor(F.log("n") * 100).alias("range")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))  # under 5,000 rows
    least, total = None, 0
    for r in sorted(ranges.collect(), key=lambda r: -r["range"]):
        total += r["words"]
        if total > size:
            break
        least = r["least"]
    return [] if least is None else [r["word"] for r in counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").collect()]


def vector(text: str, a: int, b: int, path: str, known: Dictionary, lexicon: Lexicon) -> list[float]:
    """Features of a candidate."""
    run, before, after = text[a:b], text[max(0, a - BEFORE) : a], text[b : b + AFTER]
    n = len(run)
    kinds = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in run]
    counts = [run.count(c) / n for c in set(run)]
    return [
        float(n), *[kinds.count(k) / n for k in range(4)],
        sum(x != y for x, y in zip(kinds, kinds[1:])) / max(1, n - 1),
        -sum(p * math.log2(p) for p in counts),
        known.likelihood(run), known.coverage(run),
        float(all(c in "0123456789abcdef" for c in run)),
        *lexicon.scores(text, a, b, path),
        float(bool(ASSIGNED.search(before))), float(bool(PLACE.search(before) or after[:1] in ("@", "."))),
        float(run.count("-") + run.count("/") + run.count("_")) / n,
        float(bool(URL_USER.search(before)) and after[:1] == "@"), float(bool(CODE.search(run))),
    ]


@dataclass
class Forest:
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # feature, limit, left, right, value

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, limit, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                own = at[rows]
                at[rows] = np.where(x[rows, feature[own]] <= limit[own], left[own], right[own])
            out += value[at]
        return out / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 10, least: int = 3, seed: int = 5) -> Forest:
    rng = np.random.default_rng(seed)
    tries = max(2, x.shape[1] // 2)
    grown = []
    for _ in range(trees):
        own = rng.integers(0, len(x), len(x))
        nodes: list[list] = [[-1, 0.0, 0, 0, 0.0]]
        todo = [(0, own, 0)]
        while todo:
            at, rows, level = todo.pop()
            t = y[rows]
            nodes[at][4] = float(t.mean())
            if level == depth or len(rows) < 2 * least or t.min() == t.max():
                continue
            best = (1e9, -1, 0.0)
            for f in rng.choice(x.shape[1], tries, replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, s = x[rows[order], f], t[order].cumsum()
                k = np.arange(1, len(rows))
                ok = (v[1:] > v[:-1]) & (k >= least) & (len(rows) - k >= least)
                if not ok.any():
                    continue
                p, q = s[:-1] / k, (s[-1] - s[:-1]) / (len(rows) - k)
                gini = np.where(ok, k * p * (1 - p) + (len(rows) - k) * q * (1 - q), 1e9)
                i = int(gini.argmin())
                if gini[i] < best[0]:
                    middle = (v[i] + v[i + 1]) / 2
                    best = (gini[i], int(f), float(middle if middle < v[i + 1] else v[i]))
            if best[1] < 0:
                continue
            low = x[rows, best[1]] <= best[2]
            nodes[at][:4] = [best[1], best[2], len(nodes), len(nodes) + 1]
            todo += [(len(nodes), rows[low], level + 1), (len(nodes) + 1, rows[~low], level + 1)]
            nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
        cols = list(zip(*nodes))
        grown.append(tuple(np.array(c, dtype=np.float64 if i in (1, 4) else np.int64) for i, c in enumerate(cols)))
    return Forest(grown)


def labelled_findings(words: list[str], n: int = 4000, seed: int = 5) -> list[tuple[str, int, int, int, str]]:
    """(text, start, end, label, path) by rule: credentials of common formats, and harmless runs that look like them."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    low, b36, b64 = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    plain = [w for w in words if w.isascii() and len(w) <= 8] or COMMON
    short = sum(map(len, plain)) < 4 * len(plain)  # parts of words, of which it takes more
    word = lambda k=4: "".join(rng.choices(plain, k=rng.randint(1, k if short else max(1, k // 2))))
    folders = [["src", "app", "deploy", "config", "prod", "infra"], ["tests", "docs", "examples", "fixtures", "vendor", "src"]]
    where = lambda good: "" if rng.random() < 0.5 else f"{rng.choice(folders[not good or rng.random() < 0.2])}/{word(2)}/{word(2)}.{rng.choice(['py', 'env', 'json', 'md', 'yml'])}"
    out = []
    for i in range(n):
        good = i % 2
        before, after = " ".join(word() for _ in range(4)) + " ", rng.choice([" ", ". ", "\n", ", "]) + word()
        if good:
            kind = rng.randrange(6)
            if kind == 0:
                run, lead = "AKIA" + pick(string.ascii_uppercase + "234567", 16), ""
            elif kind == 1:
                run, lead = pick(low, rng.choice([12, 16, 18, 20, 24])), rng.choice(["password=", "passwd: ", "pwd=", "secret="])
            elif kind == 2:
                run, lead = pick(low, rng.choice([32, 40, 64])), rng.choice(['token = "', "token: ", "api_key=", "auth_token='", "secret = "])
            elif kind == 3:
                run, lead = rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + pick(b64, rng.randint(20, 36)), rng.choice(["", "key=", "token "])
            elif kind == 4:
                run, lead = pick(b64, rng.randint(20, 44)), rng.choice(["secret_key: ", "aws_secret=", "Bearer ", "password = "])
            else:
                run, lead = pick(b64 + "+/", 40), rng.choice(["key ", "secret ", "", "private_key="])
        else:
            kind = rng.randrange(9)
            lead = rng.choice(["", "", "", "commit ", "sha1 ", "id=", "see "])
            if kind == 0:
                run = (word(6) + word(6) + word(6)).upper()
            elif kind == 1:
                run, lead = "-".join(pick(low, k) for k in (8, 4, 4, 4, 12)), rng.choice(["uuid ", "id ", ""])
            elif kind == 2:
                run, lead = pick(low, rng.choice([32, 40, 64])), rng.choice(["commit ", "sha256: ", "md5 ", "checksum ", "etag=", "revision "])
            elif kind == 3:
                run = f"{word(6)}-{word(5)}-{rng.randint(1, 2030)}"
            elif kind == 4:
                run, lead = f"{word(5)}/{word(5)}/{rng.randint(1, 99)}/{word(4)}", rng.choice(["https://", "www.", "/"])
            elif kind == 5:
                run = pick(string.digits, rng.randint(12, 18))
            elif kind == 6:
                run, lead = rng.choice(["EXAMPLE", "changeme", "your-password-", "xxxxxxxx", "PLACEHOLDER_"]) + pick(b36, rng.randint(4, 9)), rng.choice(["password=", "token: ", ""])
            elif kind == 7:
                run = "".join(word(3).capitalize() for _ in range(5))
            else:
                run, lead = word(6) + word(6) + word(5), rng.choice(["password: ", "token of ", "key "])
            if len(run) < 12:
                run += pick(low, 12 - len(run))
        out.append((before + lead + run + after, len(before + lead), len(before + lead + run), good, where(good)))
    # Short and odd passwords that are assigned or stand in a URL, and what is no value or a plain word there.
    symbols = "!@#$%^&*?+-_.~"
    leet = str.maketrans("aeiost", "4310$7")
    for i in range(n // 2):
        good = i % 2
        before = " ".join(word() for _ in range(4)) + " "
        name, sign = rng.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "auth", "DB_PASSWORD"]), rng.choice(["=", ": ", " = ", ":"])
        quote = rng.choice(["", "", '"', "'"])
        if good:
            kind = rng.randrange(5)
            if kind == 0:
                run = word(3) + pick(string.digits, rng.randint(1, 4)) + pick(symbols, rng.randint(0, 2))
            elif kind == 1:
                run = word(3).capitalize().translate(leet) + pick(string.digits, rng.randint(1, 3)) + pick(symbols, rng.randint(0, 2))
            elif kind == 2:
                run = word(2).translate(leet) + pick(string.digits, rng.randint(0, 2)) + pick(symbols, 1) + pick(b64 + symbols, rng.randint(3, 8))
            elif kind == 3:
                run = pick(b64, 1) + pick(b64 + symbols, rng.randint(5, 24)) + pick(string.digits, 1)
            else:
                run, quote = " ".join(word(2) for _ in range(3)) + pick(string.digits + symbols, 2), rng.choice(['"', "'"])
        else:
            kind = rng.randrange(4)
            if kind < 2:
                run = rng.choice([str, str.capitalize])(word(3))
            elif kind == 2:
                run = rng.choice(["None", "null", "true", "false", "password", "secret", "****", "xxxxxxxx", "<password>", "changeme", "your-password", "example"])
            else:
                v = word(2)
                run = rng.choice([f"${{{v.upper()}}}", f"${v}", f"{{{{{v}}}}}", f"get_{v}()", f"os.environ({v})", f"process.env.{v.upper()}", f"self.{v}", f"<{v}>", f"{rng.randint(0, 99)}"])
        if rng.random() < 0.3 and " " not in run and not set("/?#@") & set(run):
            lead, after = f"{rng.choice(['postgres', 'mysql', 'https', 'redis', 'amqp', 'ftp'])}://{word(2)}:", f"@{word(2)}/{word()}"
        else:
            lead, after = name + sign + quote, quote + rng.choice([" ", ". ", "\n", ", "]) + word()
        out.append((before + lead + run + after, len(before + lead), len(before + lead + run), good, where(good)))
    return out


@dataclass
class Scanner:
    forest: Forest
    known: Dictionary
    lexicon: Lexicon

    def scores(self, rows: list[tuple[str, int, int, str]]) -> np.ndarray:
        return self.forest.predict(np.array([vector(*r, self.known, self.lexicon) for r in rows])) if rows else np.zeros(0)


def train(words: list[str] | None = None, labelled: list[tuple[str, int, int, int, str]] | None = None) -> Scanner:
    """words: of dictionary(), else a few common ones. labelled: (text, start, end, label, path), else made by rule."""
    words = words or COMMON
    labelled = labelled or labelled_findings(words)
    known, lexicon = Dictionary(words), Lexicon(labelled)
    x = np.array([vector(t, a, b, path, known, lexicon) for t, a, b, _, path in labelled])
    return Scanner(grow(x, np.array([r[3] for r in labelled], dtype=np.float64)), known, lexicon)


@functools.cache
def default_scanner() -> Scanner:
    return train()


def findings(texts: list[str], scanner: Scanner, threshold: float = 0.5, paths: list[str] | None = None) -> list[tuple[int, list[tuple[int, int, float]]]]:
    """Per text: how many candidates it has, and (start, end, score) of those the forest takes for secrets."""
    spans = [candidates(t) for t in texts]
    scores = iter(scanner.scores([(t, a, b, p) for t, p, own in zip(texts, paths or [""] * len(texts), spans) for a, b in own]).tolist())
    scored = [[(a, b, next(scores)) for a, b in own] for own in spans]
    return [(len(own), joined([s for s in own if s[2] >= threshold])) for own in scored]


def joined(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Overlapping spans as one, with the highest score."""
    out: list[tuple[int, int, float]] = []
    for a, b, score in spans:
        if out and a < out[-1][1]:
            a, b, score = out[-1][0], max(b, out[-1][1]), max(score, out[-1][2])
            out.pop()
        out.append((a, b, score))
    return out


def redact(text: str, spans: list[tuple[int, int, float]], mark: str = "<SECRET>") -> str:
    out, at = [], 0
    for a, b, _ in spans:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan(df: DataFrame, scanner: Scanner | None = None, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: key, n_candidates, n_secrets, spans ("start-end" in code points, comma-joined), redacted_sha256.
    path: a column that says where the text comes from. Without a scanner, one is trained on the words of df."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(scanner or train(dictionary(df, text)))  # under 2 MB

    def make():
        own = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            found = findings(texts, own, paths=batch.column(2).to_pylist())
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([len(spans) for _, spans in found], pa.int64()),
                    pa.array([",".join(f"{a}-{b}" for a, b, _ in spans) for _, spans in found], pa.string()),
                    pa.array([hashlib.sha256(redact(t, spans).encode()).hexdigest() for t, (_, spans) in zip(texts, found)], pa.string()),
                ],
                names=[key, "n_candidates", "n_secrets", "spans", "redacted_sha256"],
            )

        return work

    where = F.lit("") if path is None else F.coalesce(F.col(path), F.lit(""))
    rows = df.select(F.col(key).alias("key"), text_or_empty(text).alias("text"), where.alias("path"))
    return map_texts(rows, "text", f"`{key}` {kind}, n_candidates long, n_secrets long, spans string, redacted_sha256 string", make)


def remove_secrets(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """docs with every secret replaced in text, and n_chars counted again where it is there."""
    shared, names = docs.sparkSession.sparkContext.broadcast(scanner or train(dictionary(docs))), docs.columns

    def make():
        own = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = names.index("text")
            texts = batch.column(at).to_pylist()
            new = [t if t is None else redact(t, spans) for t, (_, spans) in zip(texts, findings([t or "" for t in texts], own))]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = columns[k].to_pylist()
                columns[k] = pa.array([o if t is None or t == n else len(n) for o, t, n in zip(old, texts, new)], batch.schema.field(k).type)
            return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        return work

    return map_texts(docs, "text", docs.schema, make)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
