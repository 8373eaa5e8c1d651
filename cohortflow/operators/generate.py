"""Event generation: outcomes from a deterministic model or a chat backend, selections, evaluations."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import identity
from ..functions import payload as P
from .selection import execute
from .validate import Field, check_payload


@F.pandas_udf(StringType())
def _digest64(text: pd.Series) -> pd.Series:
    return text.map(lambda s: str(int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big")), na_action="ignore")


def deterministic(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """Adds a column per field from u, the 64-bit hash of panelist, product and period: choices by u mod
    n, whole numbers low + u mod span, decimals in steps of a ten-thousandth of the range, flags u mod 2."""
    key = F.concat(*[x for c in ("panelist_id", "product_id", "t") for x in (F.lit("|"), F.coalesce(F.col(c).cast("string"), F.lit("None")))][1:])
    out = rows.withColumn("_u", _digest64(key).cast("decimal(20,0)"))

    def mod(n: int) -> Column:
        return F.pmod(F.col("_u"), F.lit(n).cast("decimal(20,0)")).cast("bigint")

    for f in fields:
        low = f.low if f.low is not None else 0
        high = f.high if f.high is not None else (10 if f.type == "int" else 1)
        if f.choices:
            value = F.element_at(F.array(*[F.lit(c) for c in f.choices]), (mod(len(f.choices)) + 1).cast("int"))
        elif f.type == "int":
            value = F.lit(int(low)) + mod(int(high) - int(low) + 1)
        elif f.type == "float":
            value = F.lit(float(low)) + (float(high) - float(low)) * mod(10_000) / 10_000
        elif f.type == "bool":
            value = mod(2) == 1
        elif f.type == "text":
            value = F.concat(F.lit("deterministic "), F.col("_u").cast("string"))
        else:
            value = F.lit("{}")
        out = out.withColumn(f.name, value)
    return out.drop("_u")


def evaluation_events(rows: DataFrame, fields: list[Field], policy: str = "random", *keep: str, namespace: str = "events") -> DataFrame:
    """Canonical evaluation events from assigned rows that have a column per field; keep: further columns. Rows of a
    selection have its selection_id, which is part of their ids."""
    chosen = F.col("selection_id") if "selection_id" in rows.columns else F.lit(None).cast("string")
    ids = identity.evaluation_id(namespace, F.lit(policy), F.col("panelist_id"), F.col("t"), F.col("product_id"), chosen)
    shown = F.coalesce("product_display", "product_id") if "product_display" in rows.columns else F.col("product_id")
    outcomes = F.to_variant_object(F.struct(*[f.name for f in fields]))
    return rows.select(F.lit("0.1.0").alias("schema_version"), ids.alias("event_id"), F.lit("evaluation").alias("event_type"), F.lit(policy).alias("policy"), "panelist_id", "t", "product_id", shown.alias("product_display"), outcomes.alias("outcomes"), *keep)


def render(template: str, **values: Column) -> Column:
    """A prompt: {name} is replaced by the column of that name."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def field_lines(fields: list[Field]) -> str:
    """The part of a prompt that tells which keys a reply must have."""
    lines = []
    for f in fields:
        limit = f" one of {list(f.choices)}" if f.choices else f" from {f.low} to {f.high}" if f.low is not None or f.high is not None else ""
        lines.append(f"- {f.name} ({f.type}{', required' if f.required else ''}):{limit}".rstrip(":"))
    return "\n".join(lines)


#: Placeholders of few-shot examples and the place on the menu that each stands for.
PLACEHOLDERS = {"__FIRST_SHOWN__": 1, "__SECOND_SHOWN_IF_AVAILABLE__": 2, "__THIRD_SHOWN_IF_AVAILABLE__": 3}


def example_choices(tokens: list[str], choice_set: Column) -> Column:
    """The products that an example's tokens stand for on this menu; unavailable ones are left out, and so
    are literal ids that are not shown."""
    picks = []
    for token in tokens:
        if token in PLACEHOLDERS:
            picks.append(F.try_element_at(choice_set, F.lit(PLACEHOLDERS[token])))
        else:
            picks.append(F.when(F.array_contains(choice_set, token), F.lit(token)))
    return F.array_distinct(F.array_compact(F.array(*picks)))


@dataclass(frozen=True)
class Settings:
    temperature: float = 0.7
    max_tokens: int = 512
    timeout: float = 60.0


class MockBackend:
    """Answers from the prompt's hash: the same reply for the same prompt."""

    def __init__(self, reply: Callable[[str, int], str] | None = None):
        self.reply = reply or (lambda prompt, u: json.dumps({"rating": 1 + u % 5, "intent": ("no", "maybe", "yes")[u % 3]}))

    def chat(self, messages: list[dict], settings: Settings) -> str:
        text = json.dumps(messages, sort_keys=True)
        return self.reply(messages[-1]["content"], int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big"))


class HttpBackend:
    """A chat endpoint over HTTP: style "chat" (/api/chat) or "completions" (choices[0].message)."""

    def __init__(self, url: str, model: str, style: str = "completions", key_variable: str | None = None):
        self.url, self.model, self.style, self.key_variable = url, model, style, key_variable

    def chat(self, messages: list[dict], settings: Settings) -> str:
        if self.style == "chat":
            body = {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": settings.temperature, "num_predict": settings.max_tokens}}
        else:
            body = {"model": self.model, "messages": messages, "temperature": settings.temperature, "max_tokens": settings.max_tokens}
        headers = {"Content-Type": "application/json"}
        if self.key_variable and os.environ.get(self.key_variable):
            headers["Authorization"] = "Bearer " + os.environ[self.key_variable]
        with urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=settings.timeout) as answer:
            return self.text(json.load(answer))

    @staticmethod
    def text(answer: dict) -> str:
        if "message" in answer:
            return answer["message"]["content"]
        choice = answer["choices"][0]
        return choice["message"]["content"] if "message" in choice else choice["text"]


#: Backends by lower-case name; users add their own.
BACKENDS: dict[str, Callable] = {"mock": MockBackend, "ollama": lambda **kw: HttpBackend(style="chat", **kw), "server": HttpBackend}


def chat(rows: DataFrame, prompt: str, backend: dict, system: str = "", settings: Settings | None = None) -> DataFrame:
    """Adds `reply` and `chat_error`. Calls are not idempotent: write the result before it is used twice."""
    settings = settings or Settings()
    options = dict(backend)
    make = BACKENDS[options.pop("name").lower()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make(**options)
        for frame in frames:
            replies, errors = [], []
            for text in frame[prompt]:
                messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": text}]
                try:
                    replies.append(client.chat(messages, settings)), errors.append(None)
                except (OSError, ValueError, KeyError, IndexError) as e:
                    replies.append(None), errors.append(f"{type(e).__name__}: {e}"[:200])
            yield frame.assign(reply=replies, chat_error=errors)

    return rows.mapInPandas(run, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + ", reply string, chat_error string")


def read_reply(rows: DataFrame, outcomes: list[Field], traces: list[Field] = ()) -> DataFrame:
    """Adds `outcomes` (VARIANT, null unless the reply parses and is valid), `problem` and `raw_excerpt`."""
    parsed = rows.withColumn("_p", P.json_object(F.col("reply")))
    errors, warnings = check_payload(F.col("_p"), list(outcomes), list(traces))
    parsed = parsed.withColumn("_e", errors)
    good = F.col("_p").isNotNull() & (F.size("_e") == 0)
    problem = F.when(F.col("_p").isNull(), F.array(F.lit("parse_error"))).otherwise(F.concat("_e", warnings))
    return parsed.withColumn("outcomes", F.when(good, F.col("_p"))).withColumn("problem", problem).withColumn("raw_excerpt", F.when(~good, P.excerpt(F.col("reply")))).drop("_p", "_e")


def read_selection(rows: DataFrame, key: str = "selected_product_ids", cap: int | None = None, fallback_first: bool = True) -> DataFrame:
    """Adds requested, executed, dropped from a reply over choice_set; wrong replies request nothing."""
    # each step is a column of its own, so that none is worked out anew where the next names it several times
    out = rows.withColumn("_json", P.json_object(F.col("reply"))).withColumn("_list", P.strings(F.col("_json"), key))
    out = out.withColumn("requested", F.array_distinct(P.clean_list(F.col("_list")))).drop("_json", "_list")
    executed, dropped = execute(F.col("requested"), F.col("choice_set"), cap, fallback_first)
    return out.withColumn("executed", executed).withColumn("dropped", dropped)


def enrich_text(records: DataFrame, key: str, template: str, backend: dict, text_col: str = "text", overwrite: bool = False) -> DataFrame:
    """Fills blank texts of persona or product records by a backend from their attributes."""
    blank = F.lit(overwrite) | P.clean_text(F.col(text_col)).isNull()
    todo = records.where(blank).withColumn("_prompt", render(template, attributes=F.to_json("attributes"), id=F.col(key)))
    done = chat(todo.select(key, "_prompt"), "_prompt", backend).select(key, P.clean_text(F.col("reply")).alias("_new"))
    return records.join(done, key, "left").withColumn(text_col, F.coalesce("_new", text_col)).drop("_new")


def make_records(spark, n: int, prefix: str, template: str, backend: dict, batch: int = 10) -> DataFrame:
    """Generated records: a backend answers {"records": [..]} for each batch; ids are prefix and number.
    A batch that does not hold as many records as asked for fails."""
    batches = spark.range(-(-n // batch)).select("id", F.least(F.lit(batch), F.lit(n) - F.col("id") * batch).alias("want"))
    asked = chat(batches.withColumn("prompt", render(template, n=F.col("want"), batch=F.col("id"))), "prompt", backend)
    items = F.try_variant_get(P.json_object(F.col("reply")), "$.records", "array<variant>")
    wrong = F.raise_error(F.concat(F.lit("wrong number of records in batch "), F.col("id").cast("string"))).cast("array<variant>")
    checked = asked.select("id", F.when(F.coalesce(F.size(items), F.lit(-1)) == F.col("want"), items).otherwise(wrong).alias("items"))
    rows = checked.select("id", F.posexplode("items").alias("pos", "attributes"))
    return rows.select(F.concat(F.lit(prefix), F.lpad((F.col("id") * batch + F.col("pos") + 1).cast("string"), 4, "0")).alias("record_id"), "attributes")
