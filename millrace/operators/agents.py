"""Calls to outside models: embedding and chat clients, and bounded agent loops around them.

Clients are made once per task. The stubs answer by rule and need no network; real ones
are given by the caller.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EmbeddingClient(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ChatClient(Protocol):
    def ask(self, prompt: str) -> str: ...


class HashEmbedding:
    """A stub: the vector of a text is the sum of hashed character trigrams, of length 1."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts):
        out = []
        for text in texts:
            v = np.zeros(self.size)
            for i in range(max(1, len(text) - 2)):
                h = hashlib.blake2b(text[i : i + 3].encode(), digest_size=8).digest()
                v[h[0] % self.size] += 1 if h[1] & 1 else -1
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out


class RuleChat:
    """A stub: answers with the first rule whose words stand in the prompt."""

    def __init__(self, rules: list[tuple[str, str]], otherwise: str = '{"action": "final", "decision": "abstain"}'):
        self.rules, self.otherwise = rules, otherwise

    def ask(self, prompt):
        return next((answer for words, answer in self.rules if words in prompt), self.otherwise)


def _post(url: str, payload: dict, timeout: float, headers: dict | None = None) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"} | (headers or {}))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return json.loads(response.read())
    except (urllib.error.URLError, TimeoutError, OSError) as e:
        raise RuntimeError(f"{url}: {e}") from e


class HttpEmbedding:
    """A server's embeddings in batches; a batch that fails is halved, a single text retried, lack of memory raised at once."""

    def __init__(self, url: str, model: str, batch: int = 8, retries: int = 2, delay: float = 0.5, timeout: float = 60.0, post: Callable = _post):
        self.url, self.model, self.batch, self.retries, self.delay, self.timeout, self.post = url, model, max(1, batch), retries, delay, timeout, post

    def embed(self, texts):
        return [v for i in range(0, len(texts), self.batch) for v in self._some(texts[i : i + self.batch], self.retries)]

    def _some(self, texts, retries):
        try:
            found = self.post(self.url, {"model": self.model, "input": texts}, self.timeout).get("embeddings")
            if not isinstance(found, list) or len(found) != len(texts):
                raise RuntimeError("as many vectors as texts were expected")
            return found
        except RuntimeError as e:
            if "out of memory" in str(e).lower():
                raise
            if len(texts) > 1:
                half = len(texts) // 2
                return self._some(texts[:half], retries) + self._some(texts[half:], retries)
            if retries <= 0:
                raise
            time.sleep(self.delay)
            return self._some(texts, retries - 1)


class HttpChat:
    """A chat server with the usual completions interface."""

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 60.0, max_tokens: int = 256, post: Callable = _post):
        self.url, self.model, self.key, self.timeout, self.max_tokens, self.post, self.tokens = url, model, key, timeout, max_tokens, post, 0

    def ask(self, prompt):
        answer = self.post(self.url, {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.max_tokens, "temperature": 0}, self.timeout, {"Authorization": f"Bearer {self.key}"} if self.key else None)
        self.tokens += int(answer.get("usage", {}).get("total_tokens", 0))
        return answer["choices"][0]["message"]["content"]


def parsed(raw: str) -> dict:
    """The outermost JSON object of an answer, fenced or not; empty if there is none."""
    m = re.search(r"\{.*\}", raw, re.S)
    try:
        out = json.loads(m[0]) if m else {}
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def expert(row: dict, client: ChatClient, steps: int = 4) -> dict:
    """One case: the model may look at evidence and definitions, and then keeps, selects or abstains.

    It must have seen the evidence, and the definitions too if it changes the label; a
    label outside the allowed ones, a fault or too many steps fall back to the baseline.
    """
    began = time.perf_counter()
    allowed, seen, trace = list(row["candidates"]), set(), []
    prompt = f"article: {row['title']}\nbaseline: {row['baseline']}\nallowed: {', '.join(allowed)}"

    def done(label: str, decision: str, fallback: bool) -> dict:
        return {"article_id": row["article_id"], "label": label, "decision": decision, "fallback": fallback, "changed": label != row["baseline"], "steps": len(trace), "tools": trace, "latency_ms": int((time.perf_counter() - began) * 1000)}

    for _ in range(steps):
        try:
            action = parsed(client.ask(prompt))
        except Exception:  # a client's fault must not lose the row
            return done(row["baseline"], "fallback", True)
        name = str(action.get("action", ""))
        trace.append(name or "invalid")
        if name == "evidence":
            seen.add(name)
            prompt += f"\nevidence: {row['content'][:400]}"
        elif name == "definitions":
            seen.add(name)
            prompt += f"\ndefinitions: {', '.join(allowed)}"
        elif name == "final":
            decision, label = action.get("decision"), action.get("label", row["baseline"])
            if decision == "abstain":
                return done(row["baseline"], "abstain", False)
            if "evidence" not in seen or label not in {*allowed, row["baseline"]}:
                return done(row["baseline"], "fallback", True)
            if label != row["baseline"]:
                return done(label, "select", False) if "definitions" in seen else done(row["baseline"], "fallback", True)
            return done(label, "keep", False)
        else:
            return done(row["baseline"], "fallback", True)
    return done(row["baseline"], "fallback", True)


DECISION = "article_id string, label string, decision string, fallback boolean, changed boolean, steps int, tools array<string>, latency_ms long"


def run_expert(cases: DataFrame, make_client: Callable[[], ChatClient], steps: int = 4) -> DataFrame:
    """cases (article_id, title, content, baseline, candidates) -> decisions; tasks work side by side, each with one client."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        names = [c.split()[0] for c in DECISION.split(", ")]
        for pdf in parts:
            rows = [expert(r, client, steps) for r in pdf.fillna({"title": "", "content": ""}).to_dict("records")]
            yield pd.DataFrame(rows, columns=names)

    return cases.select("article_id", "title", "content", "baseline", "candidates").mapInPandas(run, DECISION)


def judged(cases: DataFrame, make_client: Callable[[], ChatClient], question: str, columns: list[str], answers: tuple[str, ...], otherwise: str) -> DataFrame:
    """cases with `answer`: what the model says of the question about the columns, if it is one of answers, else otherwise."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in parts:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    said = parsed(client.ask(question + "\n" + "\n".join(f"{c}: {row[c]}" for c in columns))).get("answer")
                except Exception:
                    said = None
                out.append(said if said in answers else otherwise)
            yield pdf.assign(answer=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema)
    return cases.mapInPandas(run, f"{kinds}, answer string")


def verified(decisions: DataFrame, make_client: Callable[[], ChatClient]) -> DataFrame:
    """Decisions of which real changes stand only if the verifier accepts them; by default it rejects.

    decisions (article_id, baseline, label, ...).
    """
    changes = judged(decisions.filter("label <> baseline").select("article_id", "baseline", "label"), make_client, "accept or reject the change", ["baseline", "label"], ("accept", "reject"), "reject")
    out = decisions.join(changes.select("article_id", "answer"), "article_id", "left")
    return out.withColumn("label", F.when(F.coalesce("answer", F.lit("accept")) == "accept", F.col("label")).otherwise(F.col("baseline"))).withColumnRenamed("answer", "verdict")


def taught(cases: DataFrame, make_client: Callable[[], ChatClient]) -> DataFrame:
    """cases (article_id, title, candidates) with the teacher's label among the candidates, or null where it abstains."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in parts:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    said = parsed(client.ask(f"label: {row['title']}\ncandidates: {', '.join(row['candidates'])}")).get("label")
                except Exception:
                    said = None
                out.append(said if said in set(row["candidates"]) else None)
            yield pd.DataFrame({"article_id": pdf["article_id"], "label": out})

    return cases.select("article_id", "title", "candidates").mapInPandas(run, f"article_id {cases.schema['article_id'].dataType.simpleString()}, label string")


def pair_scores(pairs: DataFrame, make_client: Callable[[], EmbeddingClient]) -> DataFrame:
    """pairs (pair_id, left_text, right_text) with the cosine of their texts, to 6 places; each distinct text is embedded once."""
    from millrace.functions.similarity import cosine
    from millrace.session import cut
    from millrace.sources.vectors import embed

    texts = pairs.select(F.col("left_text").alias("text")).unionByName(pairs.select(F.col("right_text").alias("text"))).distinct()
    vectors = cut(embed(texts.withColumn("key", F.col("text")), make_client, "key", "text"))
    l, r = vectors.select(F.col("key").alias("left_text"), F.col("embedding").alias("l")), vectors.select(F.col("key").alias("right_text"), F.col("embedding").alias("r"))
    return pairs.join(l, "left_text").join(r, "right_text").select("pair_id", F.bround(cosine("l", "r"), 6).alias("semantic"))
