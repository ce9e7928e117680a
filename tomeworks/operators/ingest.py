"""Sending documents to a service, behind a transport that can be put in."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDPOINTS = ("train", "chat", "embed", "upload")
TIMEOUT, TEST_TIMEOUT = 60, 30
CHAT_CHARS = 1000
SMALL_FILES, SMALL_BYTES = 10, 1 << 20
#: transport(url, headers, payload, timeout) -> (status, body)
Transport = Callable[[str, dict, dict, int], tuple[int, str]]


def http(url: str, headers: dict, payload: dict, timeout: int) -> tuple[int, str]:
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, json.dumps(payload).encode(), {**headers, "Content-Type": "application/json"}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def _token() -> str:
    token = os.environ.get("ACCESS_TOKEN")
    if not token:
        raise OSError("the environment variable ACCESS_TOKEN isn't set")
    return token


def payload(endpoint: str, text: str) -> dict:
    if endpoint not in ENDPOINTS:
        raise ValueError(f"unknown endpoint {endpoint}; one of {', '.join(ENDPOINTS)}")
    return {"message": f"Please analyze this content: {text}"} if endpoint == "chat" else {"content": text}


def send(text: str, base_url: str, endpoint: str = "train", transport: Transport = http, token: str | None = None) -> dict:
    """The service's answer; RuntimeError unless its status is 200. The token is the environment's unless one is given."""
    body = payload(endpoint, text)
    status, answer = transport(f"{base_url.rstrip('/')}/{endpoint}", {"x-access-tokens": token or _token()}, body, TIMEOUT)
    if status != 200:
        raise RuntimeError(f"{endpoint} answered {status}: {answer[:200]}")
    return json.loads(answer)


def try_endpoints(text: str, base_url: str, transport: Transport = http) -> dict[str, dict]:
    """What each endpoint answers: status_code, success, response_size, content_length and error."""
    out = {}
    for endpoint in ENDPOINTS:
        body = payload(endpoint, text[:CHAT_CHARS] + "..." if endpoint == "chat" else text)
        try:
            status, answer = transport(f"{base_url.rstrip('/')}/{endpoint}", {"x-access-tokens": _token()}, body, TEST_TIMEOUT)
            out[endpoint] = {"status_code": status, "success": status == 200, "response_size": len(answer), "content_length": len(text), "error": None if status == 200 else answer}
        except (TimeoutError, ConnectionError) as e:
            out[endpoint] = {"status_code": None, "success": False, "response_size": 0, "content_length": len(text), "error": str(e)}
    return out


def accepted(answer: Column) -> Column:
    """Whether a JSON answer tells of success: it isn't empty and holds an embedding, or its response tells of no error."""
    empty = answer.isNull() | F.trim(answer).isin("", "{}", "null", "[]")
    parsed = F.try_parse_json(answer)
    value = lambda path: F.try_variant_get(parsed, path, "string")
    response = F.coalesce(value("$.response"), F.lit(""))
    return F.when(empty | parsed.isNull(), False).otherwise(value("$.embedding").isNotNull() | ~F.lower(response).contains("error"))


def sent(documents: DataFrame, base_url: str, endpoint: str = "train", transport: Transport = http) -> DataFrame:
    """(rel_path, answer, error, ok) of (rel_path, content): executors send, one document after the other."""
    payload(endpoint, "")
    token = _token()  # read here, as executors have an environment of their own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers, errors = [], []
            for text in b["content"].to_pylist():
                try:
                    answers.append(json.dumps(send(text or "", base_url, endpoint, transport, token)))
                    errors.append(None)
                except (RuntimeError, OSError, ValueError) as e:
                    answers.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b["rel_path"], pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["rel_path", "answer", "error"])

    out = documents.select(F.col("rel_path").cast("string"), F.col("content").cast("string")).mapInArrow(run, "rel_path string, answer string, error string")
    return out.withColumn("ok", accepted(F.col("answer")))


def method(files: DataFrame) -> str:
    """`directory` for at most ten files of less than a megabyte together, else `archive`."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return "directory" if n <= SMALL_FILES and size < SMALL_BYTES else "archive"


def generation_prompt(plan: str, library: str, day: str) -> str:
    """A request to a language model for an archive that carries out a study plan with a library."""
    rule = "#" * 80
    shape = "\n".join(["# LLM-FRIENDLY CODE ARCHIVE", "# Generated from: study", f"# Date: {day}", "# TABLE OF CONTENTS", "1. <name>.ipynb", "", rule, "# FILE 1: <name>.ipynb", rule, "# Cell 1", "<code>"])
    return f"Write notebooks that carry out the plan with the library given.\n\nPlan:\n{plan}\n\nLibrary:\n{library}\n\nAnswer with nothing but an archive of this shape:\n\n{shape}\n"


def stand_in(prompt: str) -> str:
    """What a model might answer, for tests."""
    rule = "#" * 80
    out = ["# LLM-FRIENDLY CODE ARCHIVE", "# Generated from: study", "# Date: 2025-01-01", "# TABLE OF CONTENTS", "1. prepare.ipynb", "2. analyse.ipynb", ""]
    for n, (name, code) in enumerate((("prepare", "rows = load('data.csv')"), ("analyse", "model = fit(rows)")), 1):
        out += [rule, f"# FILE {n}: {name}.ipynb", rule, "# Cell 1", code, ""]
    return "\n".join(out)


def generate(plan: str, library: str, day: str, model: str | Callable[[str], str] = "mock") -> str:
    """The archive that a model writes; models other than the stand-in are functions from prompt to answer."""
    prompt = generation_prompt(plan, library, day)
    if callable(model):
        return model(prompt)
    if model != "mock":
        raise NotImplementedError("give a function from prompt to answer")
    return stand_in(prompt)
