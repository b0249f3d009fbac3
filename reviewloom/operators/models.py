"""Plug-ins for language and embedding models, with deterministic stand-ins.

A plug-in is a factory called once per Python worker; what it returns is called
with batches, so clients and weights are opened once. The stand-ins need no
network and make every pipeline runnable and testable.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import rules as R

Texts = Callable[[list[str]], list[str]]
Vectors = Callable[[list[str]], list[list[float]]]

MATCH_TEMPLATE = "Do these two columns hold the same information?\nColumn A: {source} - {source_description}.{samples}\nColumn B: {target} - {target_description}.\n{closing}"
REASONED, DIRECT = "Explain first, then give Yes or No alone on the last line.", "Answer Yes or No."
DESCRIBE_TEMPLATE = "Describe the database column {name} of a review tracker in one sentence of at most 25 words.\n{context}\nThis column"


# Fixed value: an instruction that describers repeat; it is taken off their answers.
ECHO = "Complete this exactly: This column"


def match_prompt(reasoned: bool = True, with_samples: bool = True, template: str = MATCH_TEMPLATE) -> Column:
    """The question about a pair; the template may be replaced."""
    s = R.sample_text([F.col(f"sample_{i}") for i in (1, 2, 3)])
    samples = F.when(s != "", F.concat(F.lit(" Samples: "), s, F.lit("."))).otherwise("") if with_samples else F.lit("")
    holes = {"source": F.col("source_column"), "source_description": F.col("source_description"), "samples": samples, "target": F.col("target_column"), "target_description": F.col("target_description"), "closing": F.lit(REASONED if reasoned else DIRECT)}
    return fill(template, holes)


def describe_prompt(name: Column, samples: Column | None = None, existing: Column | None = None, template: str = DESCRIBE_TEMPLATE) -> Column:
    """By sample values, by an existing description, or by the name alone."""
    none = F.lit("Sample values: (none provided)")
    context = none if samples is None and existing is None else F.concat(F.lit("Sample values: "), samples) if samples is not None else F.concat(F.lit("Current description: "), existing)
    return fill(template, {"name": name, "context": F.coalesce(context, none)})


def fill(template: str, holes: dict[str, Column]) -> Column:
    """The template with its {holes} filled; a null fills as ''."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(holes[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def embed_text(name: Column, description: Column) -> Column:
    """P14."""
    return F.concat_ws(" ", name, description)


def hash_embedder(dim: int = 64) -> Vectors:
    """Words hashed into `dim` signed places: a stand-in for an embedding model."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def keyword_judge() -> Texts:
    """Yes where the two columns of a match prompt share a word: a stand-in for a judge."""

    def judge(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            a, _, b = p.partition("\nColumn B: ")
            words = [set(re.findall(r"[a-z]{4,}", re.sub(r"_", " ", x.split(":", 1)[-1].split(".")[0].lower()))) - {"this", "holds", "column", "values", "under", "header", "text"} for x in (a, b)]
            out.append("Yes" if words[0] & words[1] else "No")
        return out

    return judge


def name_describer() -> Texts:
    """Descriptions made of the column's name: a stand-in for a describer."""

    def describe(prompts: list[str]) -> list[str]:
        return ["This column holds " + m[1] + "." if (m := re.search(r"column (.+?) of a review", p or "")) else "" for p in prompts]

    return describe


def http_generator(url: str, model: str, tokens: int = 50, context: int = 2048, temperature: float = 0.1, stop: tuple[str, ...] = ("\n",), timeout: float = 60, failed: str = "", retries: int = 1, at_once: int = 4) -> Callable[[], Texts]:
    """A generation server's /api/generate; `retries` errors or empty answers give `failed`.

    A worker has `at_once` requests of a batch under way.
    """

    def make() -> Texts:
        def ask(prompt: str) -> str:
            body = {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": temperature, "num_ctx": context, "num_predict": tokens, "stop": list(stop)}}
            for _ in range(retries):
                try:
                    request = urllib.request.Request(f"{url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
                    with urllib.request.urlopen(request, timeout=timeout) as r:
                        if text := json.load(r).get("response", "").strip():
                            return text
                except (OSError, ValueError):
                    continue
            return failed

        def ask_all(prompts: list[str]) -> list[str]:
            with ThreadPoolExecutor(at_once) as pool:
                return list(pool.map(ask, prompts))

        return ask_all

    return make


def local_judge(model: str, tokens: int = 150) -> Callable[[], Texts]:
    """A local language model, if the packages for it are installed; greedy, a batch at a time."""

    def make() -> Texts:
        from transformers import pipeline  # an optional package

        run = pipeline("text-generation", model=model, return_full_text=False)
        return lambda prompts: [r[0]["generated_text"] for r in run(prompts, max_new_tokens=tokens, do_sample=False)]

    return make


def local_embedder(model: str) -> Callable[[], Vectors]:
    """A local embedding model, if the packages for it are installed."""

    def make() -> Vectors:
        from sentence_transformers import SentenceTransformer  # an optional package

        m = SentenceTransformer(model)
        return lambda texts: m.encode(texts, batch_size=256).tolist()

    return make


def plug_ins(model: str = "offline", server: str = "", embedding: str = "offline", reasoned: bool = False) -> tuple:
    """(embedder, judge, describer) by settings: stand-ins, a generation server, or local models.

    A server that does not answer is an error before the job starts.
    """
    embedder = hash_embedder if embedding == "offline" else local_embedder(embedding)
    tokens = 150 if reasoned else 5
    if model == "offline":
        return embedder, keyword_judge, name_describer
    if server:
        if not server_ready(server):
            raise ConnectionError(f"no generation server answers at {server}")
        return embedder, http_generator(server, model, tokens=tokens, stop=()), http_generator(server, model)
    return embedder, local_judge(model, tokens), local_judge(model, 50)


def server_ready(url: str, timeout: float = 5) -> bool:
    """Whether a generation server answers /api/tags."""
    try:
        with urllib.request.urlopen(f"{url}/api/tags", timeout=timeout) as r:
            return r.status == 200
    except OSError:
        return False


def generate(prompt: Column, make: Callable[[], Texts]) -> Column:
    """A model's text for each prompt, opened once per worker."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield pd.Series(model(s.tolist()), dtype=object)

    return run(prompt)


def embed(text: Column, make: Callable[[], Vectors]) -> Column:
    """A model's vector for each text."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield pd.Series(model(s.tolist()), dtype=object)

    return run(text)


def describe(pairs: DataFrame, make: Callable[[], Texts], variants: int = 3) -> DataFrame:
    """Descriptions of each different (column, samples) and target, joined back."""
    keyed = pairs.withColumn("samples_key", R.samples_key([F.col(c) for c in pairs.columns if c.startswith("sample_")]))
    cols = [F.col(c) for c in pairs.columns if c.startswith("sample_")]
    src = keyed.select("source_column", "samples_key", R.sample_text(cols).alias("s")).distinct()
    prompt = describe_prompt(F.col("source_column"), F.nullif("s", F.lit("")))
    src = src.select("source_column", "samples_key", *[R.clean_response(generate(F.concat(prompt, F.lit(" " * i)), make), ECHO).alias(f"source_description_{i + 1}") for i in range(variants)])
    tgt = pairs.select("target_column", "target_description").where("target_column is not null").groupBy("target_column").agg(F.min("target_description").alias("d"))
    tgt = tgt.select("target_column", R.clean_response(generate(describe_prompt(F.col("target_column"), existing=F.col("d")), make), ECHO).alias("new_description"))
    x = keyed.join(src, ["source_column", "samples_key"], "left").join(tgt, "target_column", "left")
    return x.withColumn("target_description", F.coalesce("new_description", "target_description")).drop("new_description")


def judge(pairs: DataFrame, make: Callable[[], Texts], reasoned: bool = False, with_samples: bool = True) -> DataFrame:
    """Three answers to each different pair and their vote."""
    from reviewloom.operators.matching import first_by, voted

    once = first_by(pairs, ["source_column", "target_column"], "pair_id")
    for i in (1, 2, 3):
        d = f"source_description_{i}"
        if d in pairs.columns:
            once = once.withColumn("source_description", F.col(d))
        once = once.withColumn(f"prompt_{i}", match_prompt(reasoned, with_samples))
    for i in (1, 2, 3):
        once = once.withColumn(f"raw_output_{i}", generate(F.col(f"prompt_{i}"), make)).withColumn(f"output_{i}", R.last_line_answer(F.col(f"raw_output_{i}")) if reasoned else R.any_answer(F.col(f"raw_output_{i}")))
    return voted(once)
