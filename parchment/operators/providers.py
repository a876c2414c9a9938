"""Language models, embedders and text recognisers as Arrow stages; deterministic stand-ins for tests and offline runs."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.jsontext import first_value, ocr_lines

Chat = Callable[[str], str]
Embed = Callable[[list[str]], list[list[float]]]
JSON_ONLY = "\n\nAnswer with JSON only."


def stub_embed(texts: list[str], dim: int = 64) -> list[list[float]]:
    """A unit vector for each text: signed counts of hashed words."""
    out = []
    for text in texts:
        v = np.zeros(dim, np.float32)
        for word in (text or "").lower().split():
            h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")
            v[h % dim] += 1 if h >> 63 else -1
        n = float(np.linalg.norm(v))
        out.append((v / n if n else v).tolist())
    return out


def embed(text: Column, provider: Embed = stub_embed) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(v) for v in provider([t or "" for t in texts])])

    return run(text)


def complete_json(prompts: DataFrame, provider: Chat, prompt: str = "prompt", retries: int = 1, pause: float = 0.0) -> DataFrame:
    """Adds raw, answer (the JSON in it) and error; asks once more if there is no JSON. Store the result before using it twice."""
    columns = prompts.columns

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            raws, answers, errors = [], [], []
            for asked in rows[prompt]:
                raw = answer = error = None
                for turn in range(retries + 1):
                    try:
                        raw = provider(f"{asked}{JSON_ONLY}")
                        answer, error = first_value(raw), None
                        json.loads(answer or "")
                        break
                    except ValueError:
                        answer, error = None, "5002: no JSON in the answer"
                    except OSError as e:
                        error = f"5002: {e}"
                    if turn < retries:
                        time.sleep(pause)
                raws.append(raw)
                answers.append(answer)
                errors.append(error)
            yield rows[columns].assign(raw=raws, answer=answers, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(over, f"{fields}, raw string, answer string, error string")


def recognize(images: DataFrame, provider: Callable[[bytes], str], most: int = 60) -> DataFrame:
    """images (doc_id, page_no, png): text and mean confidence of each page's recognised lines; a page that fails has none.

    Only the first pages of a document are read, as a setting says.
    """

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            said = []
            for png in rows.png:
                try:
                    said.append(ocr_lines(provider(bytes(png))))
                except Exception:  # noqa: BLE001  a page must not end the job
                    said.append([])
            yield pd.DataFrame({"doc_id": rows.doc_id, "page_no": rows.page_no, "text": ["\n".join(x["text"] for x in s) for s in said], "confidence": [float(np.mean([x["confidence"] for x in s])) if s else None for s in said]})

    return images.where(F.col("page_no") <= most).select("doc_id", "page_no", "png").mapInPandas(over, "doc_id long, page_no int, text string, confidence double")


def http_chat(url: str, model: str, temperature: float = 0.2, timeout: float = 1200.0, retries: int = 1) -> Chat:
    """A chat model behind an OpenAI-compatible address; only broken connections are tried again."""

    def chat(prompt: str) -> str:
        body = json.dumps({"model": model, "temperature": temperature, "stream": False, "messages": [{"role": "user", "content": prompt}]}).encode()
        for turn in range(retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"]
            except urllib.error.HTTPError:
                raise
            except OSError:
                if turn == retries:
                    raise
        raise AssertionError

    return chat


def http_embed(url: str, model: str, timeout: float = 300.0) -> Embed:
    """Vectors from an address that takes a list of texts; where it fails for a list, texts are sent one by one."""

    def ask(texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": model, "input": texts}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
            said = json.load(answer)
        found = said["embeddings"] if "embeddings" in said else [x["embedding"] for x in said["data"]]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return found

    def run(texts: list[str]) -> list[list[float]]:
        try:
            return ask(texts)
        except (OSError, ValueError, KeyError):
            return [ask([t])[0] for t in texts]

    return run


def chosen(settings: dict[str, str]) -> tuple[Chat | None, Embed]:
    """Chat model and embedder by settings: 'kind' is 'openai', 'ollama' or 'none', with 'url', 'model', 'embed_model'."""
    kind, at = settings.get("kind", "none"), settings.get("url", "").rstrip("/")
    if kind == "none":
        return None, stub_embed
    paths = {"openai": ("/v1/chat/completions", "/v1/embeddings"), "ollama": ("/v1/chat/completions", "/api/embed")}
    if kind not in paths:
        raise ValueError(f"no provider {kind!r}")
    chat, vectors = paths[kind]
    return http_chat(at + chat, settings["model"]), http_embed(at + vectors, settings.get("embed_model", settings["model"]))


def format_prompt(template: str, *values: str) -> str:
    """%s by %s; values that are left over follow on lines of their own."""
    parts = template.split("%s")
    n = min(len(values), len(parts) - 1)
    out = parts[0] + "".join(v + p for v, p in zip(values, parts[1 : n + 1])) + "".join("%s" + p for p in parts[n + 1 :])
    return "\n".join([out, *values[n:]])


def placeholders(template: Column) -> Column:
    return F.regexp_count(template, F.lit("%s"))
