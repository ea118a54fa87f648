"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The patterns (`base_spans`) find email, ip, card and phone. The field labels the
tokens (runs without white space) of a text with begin and inside labels of those
kinds and of secrets, and adds the spans that overlap no pattern's span: numbers
without a country code, spelled-out at signs, keys and passwords.

A token without a digit, an at sign or a bracketed "at" can only be outside any span:
the field's other labels are forbidden for it. Every best path so passes through
"outside" there, and the text falls into islands of other tokens that are decoded
on their own, exactly as the whole chain would be.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.session import documents, small_batches, table

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PARTS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, not overlapping, in time linear in the text: every at sign is tried once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1  # no match can cross this at sign
        at = text.find("@", max(last, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Each run of dotted numbers holds a match for every four of them, from the left."""
    if text.find(".") < 0:
        return
    for run in PARTS.finditer(text):
        if run.group().count(".") >= 3:
            parts = list(DIGITS.finditer(text, run.start(), run.end()))
            for i in range(0, len(parts) - 3, 4):
                four = [p.group().lstrip("0") for p in parts[i : i + 4]]
                if all(len(p) < 4 and int(p or 0) <= 255 for p in four):
                    yield parts[i].start(), parts[i + 3].end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns' matches, sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    if DIGITS.search(text):
        found += [(a, 1, b) for a, b in ips(text)]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


# ---- the field -------------------------------------------------------------

MARK = re.compile(r"[0-9@]|\[at\]|\(at\)")
EDGE = " \t\n\r\v\f.,;:!?\"'<>()[]{}"
# Words before a token that tell what it is.
TRIGGERS = {
    "call": "phone", "phone": "phone", "tel": "phone", "fax": "phone", "mobile": "phone", "whatsapp": "phone",
    "email": "email", "mail": "email", "contact": "email", "write": "email",
    "ip": "ip", "host": "ip", "server": "ip", "address": "ip",
    "card": "card", "visa": "card", "mastercard": "card",
    "password": "secret", "token": "secret", "secret": "secret", "key": "secret", "apikey": "secret",
}


def shape(token: str) -> str:
    """Letters as x or X and digits as 9, each run collapsed to one; other characters stay."""
    out = []
    for c in token[:64]:
        s = "9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def token_features(token: str, before: str) -> tuple[str, ...]:
    """The word-shape features of a token and of the word before it."""
    core = token.strip(EDGE)
    digits = sum("0" <= c <= "9" for c in token)
    held = len(core)
    name = core.split("=", 1)[0].split(":", 1)[0].lower()
    return (
        f"s:{shape(core)[:16]}", f"d:{min(digits, 20)}", f"n:{min(held // 4, 8)}", f"o:{token[:1] if not token[:1].isalnum() else 'w'}",
        f"all:{digits == held}", f"hex:{held >= 16 and all(c in '0123456789abcdefABCDEF' for c in core)}", f"caps:{held >= 12 and core.isalnum() and core.upper() == core and not core.isdigit()}",
        f"at:{'@' in token or '[at]' in token or '(at)' in token}", f"dots:{min(core.count('.'), 4)}", f"dash:{min(core.count('-'), 4)}", f"set:{TRIGGERS.get(name, '-') if '=' in core or ':' in core else '-'}",
        f"after:{TRIGGERS.get(before.strip(EDGE).lower(), '-')}",
    )


@dataclass
class Field:
    """weights[feature, label] and transitions[label, next label]; paths start and end in O."""

    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, features: list[list[tuple[str, ...]]]) -> list[np.ndarray]:
        out = []
        for island in features:
            out.append(np.array([self.weights[[self.index[f] for f in own if f in self.index]].sum(0) for own in island]))
        return out

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi paths; islands of one length advance together."""
        paths: list = [None] * len(emissions)
        lengths = np.array([len(e) for e in emissions])
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            e = np.stack([emissions[i] for i in own])
            best = e[:, 0] + self.transitions[0]
            back = np.zeros((n, len(own), len(LABELS)), np.int8)
            for t in range(1, n):
                step = best[:, :, None] + self.transitions[None]
                back[t] = step.argmax(1)
                best = step.max(1) + e[:, t]
            path = np.zeros((len(own), n), np.int8)
            path[:, -1] = (best + self.transitions[:, 0]).argmax(1)
            for t in range(n - 1, 0, -1):
                path[:, t - 1] = back[t][np.arange(len(own)), path[:, t]]
            for i, p in zip(own, path):
                paths[i] = p
        return paths


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _allowed() -> np.ndarray:
    """An inside label follows only the begin or inside label of its kind."""
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            ok[:, j] = [a != "O" and a[2:] == b[2:] for a in LABELS]
    return ok


def fit(rows: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 150, rate: float = 0.1, ridge: float = 2e-3) -> Field:
    """Maximum likelihood with a ridge, by Adam over all rows (features of each token, labels); islands of one length are one batch."""
    index = {f: i for i, f in enumerate(sorted({f for features, _ in rows for own in features for f in own}))}
    n_labels = len(LABELS)
    forbidden = np.where(_allowed(), 0.0, -1e4)
    weights, transitions = np.zeros((len(index), n_labels)), np.zeros((n_labels, n_labels))
    state = [np.zeros_like(x) for x in (weights, weights, transitions, transitions)]
    groups: dict[int, list] = {}
    for features, labels in rows:
        groups.setdefault(len(labels), []).append(([[index[f] for f in own] for own in features], labels))
    batches = [(np.array([x for x, _ in own]), np.array([y for _, y in own])) for own in groups.values()]  # ids: (rows, tokens, features)
    for k in range(1, rounds + 1):
        g_w, g_t = ridge * len(rows) * weights, ridge * len(rows) * transitions
        held = transitions + forbidden
        for ids, gold in batches:
            e = weights[ids].sum(2)
            n = e.shape[1]
            forward, backward = np.zeros_like(e), np.zeros_like(e)
            forward[:, 0] = e[:, 0] + held[0]
            for t in range(1, n):
                forward[:, t] = e[:, t] + _log_sum(forward[:, t - 1, :, None] + held[None], 1)
            backward[:, -1] = held[:, 0]
            for t in range(n - 2, -1, -1):
                backward[:, t] = _log_sum(held[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            z = _log_sum(forward[:, -1] + held[:, 0], 1)
            expected = np.exp(forward + backward - z[:, None, None])
            delta = expected - np.eye(n_labels)[gold]
            np.add.at(g_w, ids.reshape(-1), np.repeat(delta.reshape(-1, n_labels), ids.shape[2], 0))
            for t in range(1, n):
                pair = np.exp(forward[:, t - 1, :, None] + held[None] + (e[:, t] + backward[:, t])[:, None, :] - z[:, None, None])
                g_t += pair.sum(0)
                np.add.at(g_t, (gold[:, t - 1], gold[:, t]), -1)
            g_t[0] += expected[:, 0].sum(0) - np.bincount(gold[:, 0], minlength=n_labels)
            g_t[:, 0] += expected[:, -1].sum(0) - np.bincount(gold[:, -1], minlength=n_labels)
        for x, g, i in ((weights, g_w / len(rows), 0), (transitions, g_t / len(rows), 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
            x -= rate * (state[i] / (1 - 0.9**k)) / (np.sqrt(state[i + 1] / (1 - 0.99**k)) + 1e-8)
    return Field(index, weights, transitions + forbidden)


# Sentences of the labelled table; {kind} is a span of that kind, {-name} harmless text that looks like one.
SENTENCES = (
    "call {phone} today", "phone {phone} or fax {phone}", "tel: {phone}.", "my number is {phone} thanks", "reach us at {phone}, please", "({phone})",
    "write to {email} soon", "email: {email}", "contact {email} or {email}", "<{email}>", "he wrote from {email}.",
    "the server {ip} is down", "host {ip}, port {-number}", "ping {ip}", "card {card} expires {-date}", "visa {card}", "paid with {card} on {-date}.",
    "{phone} {card} and", "{card} {phone}", "{email} {phone}", "{card} {ip}", "{ip} {card}", "{phone} {email} {card}", "{card} {secret}", "{phone} {phone}", "{card} {card}", "{ip} {ip}",
    "password={secret}", "the key {secret} was leaked", "token: {secret}", "api_key={secret}", "{secret} is revoked",
    "in {-year} there were {-number} cases", "version {-version} of {-date}", "it costs {-price} or {-price}", "at {-time} on {-date}", "pages {-number} {-number} {-number}",
    "see section {-version}", "a {-word} and {-word}", "room {-number}, floor {-number}", "{-number} {-number} {-price}", "order {-number} was shipped", "under CC BY {-version} terms", "{-handle} posted {-number} times", "about {-percent} of {-year}",
)


def _span(kind: str, r: np.random.Generator) -> str:
    """A made-up value of a kind, by rule."""
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    w = lambda n: "".join(chr(97 + x) for x in r.integers(0, 26, n))
    pick = lambda *x: x[r.integers(len(x))]
    if kind == "phone":
        return pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(11)}")
    if kind == "email":
        return pick(f"{w(5)}@{w(6)}.com", f"{w(4)}.{d(2)}@{w(5)}{d(1)}.{w(4)}.org", f"{w(5)}[at]{w(6)}.net", f"{w(6)}(at){w(5)}.com", f"{w(3)}_{w(4)}@{w(4)}.de")
    if kind == "ip":
        return ".".join(str(r.integers(1, 255)) for _ in range(4))
    if kind == "card":
        return pick(f"4{d(15)}", f"5{d(3)} {d(4)} {d(4)} {d(4)}", f"4{d(3)}-{d(4)}-{d(4)}-{d(4)}", f"37{d(13)}")
    if kind == "secret":
        return pick("".join(pick(*"0123456789abcdef") for _ in range(24)), "AKIA" + "".join(pick(*"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "sk-" + w(10) + d(6) + w(4) + d(2), w(6) + d(4) + w(6) + d(3) + w(5))
    return {
        "-number": lambda: pick(d(1), d(2), d(3), d(4), f"{d(2)},{d(3)}"), "-year": lambda: f"20{d(2)}", "-version": lambda: pick(f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(2)}", f"v{d(1)}.{d(1)}"),
        "-date": lambda: pick(f"20{d(2)}-0{r.integers(1, 9)}-1{d(1)}", f"1{d(1)}.0{d(1)}.20{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"0{d(1)}/2{d(1)}"), "-price": lambda: pick(f"${d(2)}.{d(2)}", f"{d(3)}.00", f"€{d(2)}"),
        "-time": lambda: f"1{d(1)}:{r.integers(10, 59)}", "-word": lambda: pick(f"{w(4)}{d(1)}", f"{w(3)}-{d(2)}", f"{w(2).upper()}{d(2)}"), "-handle": lambda: f"@{w(6)}", "-percent": lambda: f"{d(2)}%",
    }[kind]()


def islands(text: str) -> list[list[tuple[int, int, str]]]:
    """Runs of neighbouring tokens that may be in a span: (start, end, word before) of each."""
    out: list[list[tuple[int, int, str]]] = []
    at, n, m = 0, len(text), MARK.search(text)
    while m:
        start, end = m.start(), m.end()
        while start > at and not text[start - 1].isspace():
            start -= 1
        while end < n and not text[end].isspace():
            end += 1
        gap = out and text[out[-1][-1][1] : start].isspace()
        if gap:
            out[-1].append((start, end, text[out[-1][-1][0] : out[-1][-1][1]]))
        else:
            before = text[max(0, start - 40) : start].split()
            out.append([(start, end, before[-1] if before else "")])
        at = end
        m = MARK.search(text, at)
    return out


def labelled_table(copies: int = 14, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The small labelled table: made-up sentences with the spans in them (start, end, kind)."""
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(copies):
        for sentence in SENTENCES:
            text, marks = "", []
            for i, part in enumerate(re.split(r"\{([^}]+)\}", sentence)):
                if i % 2:
                    value = _span(part, r)
                    if part[0] != "-":
                        marks.append((len(text), len(text) + len(value), part))
                    text += value
                else:
                    text += part
            rows.append((text, marks))
    return rows


def training_rows(labelled) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    rows = []
    for text, marks in labelled:
        for island in islands(text):
            features, labels = [], []
            for start, end, before in island:
                kind = next(((("B" if start <= a else "I"), k) for a, b, k in marks if a < end and start < b), None)
                features.append(token_features(text[start:end], before))
                labels.append(LABELS.index("-".join(kind)) if kind else 0)
            rows.append((features, labels))
    return rows


def trained() -> Field:
    return fit(training_rows(labelled_table()))


def field_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """(start, kind's number, end) of the field's spans in each text, edges trimmed; cards and ips must be possible ones."""
    held = [(i, island) for i, text in enumerate(texts) for island in islands(text)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    known: dict[tuple[str, str], np.ndarray] = {}

    def emission(text: str, token: tuple[int, int, str]) -> np.ndarray:
        key = (text[token[0] : token[1]], token[2])
        if (e := known.get(key)) is None:
            e = known[key] = field.weights[[field.index[f] for f in token_features(*key) if f in field.index]].sum(0)
        return e

    paths = field.decode([np.array([emission(texts[i], t) for t in island]) for i, island in held])
    for (i, island), path in zip(held, paths):
        k = 0
        while k < len(path):
            label = LABELS[path[k]]
            first = k
            k += 1
            if label == "O":
                continue
            while k < len(path) and LABELS[path[k]] == f"I-{label[2:]}":
                k += 1
            start, end = island[first][0], island[k - 1][1]
            text = texts[i]
            if label[2:] == "secret" and "=" in text[start:end]:
                start += text[start:end].index("=") + 1
            while start < end and text[start] in EDGE and not (label[2:] == "phone" and text[start] == "("):
                start += 1
            while end > start and text[end - 1] in EDGE:
                end -= 1
            digits = "".join(DIGITS.findall(text[start:end]))
            kind = KINDS.index(label[2:])
            if start < end and (kind != 2 or 14 <= len(digits) <= 19 and luhn(digits)) and (kind != 1 or any(True for _ in ips(text[start:end]))) and (kind != 3 or 7 <= len(digits) <= 15):
                out[i].append((start, kind, end))
    return out


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    n_* count the patterns' spans and n_added the field's. spans is kind:start:end of
    all, by start and then kind, in code points with the end exclusive. One row per row,
    repeated rows included; a null text counts as empty and has no spans.
    """
    small_batches(docs.sparkSession)
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            added = field_spans(texts, field)
            columns: list[list] = [[] for _ in range(7)]
            write = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            for text, more in zip(texts, added):
                base = base_spans(text)
                more = apart(more, base)
                counts = [0] * len(KINDS)
                for _, k, _ in base:
                    counts[k] += 1
                for column, x in zip(columns, (*counts[:4], hashlib.sha256(write(base).encode()).hexdigest(), write(sorted(base + more)), len(more))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.string()), pa.array(columns[6], pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return documents(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def apart(more: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of more that overlap none of base; both sorted by start."""
    out, i, reach = [], 0, 0
    for start, kind, end in more:
        while i < len(base) and base[i][0] < end:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= start:
            out.append((start, kind, end))
    return out


def op2_pii(spark, sf_dir):
    """Every document's personal data."""
    return find(table(spark, sf_dir, "documents"))
