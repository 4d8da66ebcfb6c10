"""Model responses: aliases to one form, a registry of response functions, runs that turn failures into rows."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions import values as V

# The names under which providers give each field, in order.
PREDICTION_ALIASES = {
    "drug_name": ("drug_name", "item_name", "medicine_name", "name"),
    "drug_code": ("drug_code", "mfds_item_id", "item_seq"),
    "front_imprint": ("front_imprint", "imprint_front", "mark_front"),
    "back_imprint": ("back_imprint", "imprint_back", "mark_back"),
    "shape": ("shape",),
    "color": ("color", "color_front"),
    "evidence": ("evidence", "basis", "mfds_basis"),
    "uncertainty": ("uncertainty", "limitations", "caveat"),
}
USAGE_ALIASES = {
    "input_tokens": ("input_tokens", "prompt_tokens", "promptTokenCount"),
    "output_tokens": ("output_tokens", "completion_tokens", "candidatesTokenCount"),
    "cached_tokens": ("cached_tokens", "cached_input_tokens", "cachedContentTokenCount", "cache_read_input_tokens"),
    "cost_usd": ("cost_usd", "cost"),
}


def _first(json: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields that is there; an empty text counts as there."""
    return F.coalesce(*[F.get_json_object(json, f"$.{n}") for n in names])


def prediction_of(answer: Column | str) -> Column:
    """Prediction in a model's answer text: its JSON part, fields by their aliases, confidence from 0 to 100 or null."""
    part = T.json_part(answer)
    fields = [T.trimmed(_first(part, names)).alias(field) for field, names in PREDICTION_ALIASES.items()]
    confidence = V.contract_confidence(V.number_of(_first(part, ("confidence",)))).alias("confidence")
    return F.struct(*fields[:6], confidence, *fields[6:])


def usage_of(usage: Column | str) -> Column:
    """Token counts and cost in a provider's usage JSON: not negative, else null."""
    return F.struct(*[V.not_negative(V.number_of(_first(T.col(usage), names))).alias(field) for field, names in USAGE_ALIASES.items()])


def batch_predictions(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """Parts of batch answers for each case: by the case's id, else by CASE-n for the n-th case, else by its place.

    ``answers``: ``run_id, answer`` with a JSON list of objects that may carry ``case_id``; ``cases``: ``run_id,
    case_id, place``. A case without a part has null.
    """
    listed = F.from_json(T.json_part("answer"), "array<string>")
    parts = answers.select("run_id", F.posexplode(listed).alias("place", "part")).withColumn("case_id", T.trimmed(F.get_json_object("part", "$.case_id")))
    by_id = parts.filter("case_id <> ''").groupBy("run_id", "case_id").agg(F.min_by("part", "place").alias("by_id"))
    number = F.regexp_extract(F.upper("case_id"), r"^CASE-0*([0-9]{1,6})$", 1)
    by_number = parts.filter(number != "").groupBy("run_id", (number.cast("int") - 1).alias("place")).agg(F.min_by("part", "place").alias("by_number"))
    joined = cases.join(by_id, ["run_id", "case_id"], "left").join(by_number, ["run_id", "place"], "left").join(parts.select("run_id", "place", F.col("part").alias("by_place")), ["run_id", "place"], "left")
    return joined.withColumn("part", F.coalesce("by_id", "by_number", "by_place")).drop("by_id", "by_number", "by_place")


class Registry:
    """Response functions by provider id; an id is taken once unless it is replaced on purpose."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[[pd.DataFrame], list[str]]] = {}

    def register(self, provider: str, respond: Callable[[pd.DataFrame], list[str]], replace: bool = False) -> None:
        if not provider or (provider in self.known and not replace):
            raise ValueError(f"provider {provider!r} is empty or already registered")
        self.known[provider] = respond

    def get(self, provider: str) -> Callable[[pd.DataFrame], list[str]]:
        if provider not in self.known:
            raise KeyError(f"unknown provider {provider!r}")
        return self.known[provider]


def run(tasks: DataFrame, registry: Registry) -> DataFrame:
    """``task_id, provider, answer, error`` of every task; a failing or unknown provider gives rows with an error.

    ``tasks``: ``task_id, provider, input``. Inputs are answered batch by batch where they lie.
    """
    known = dict(registry.known)

    def respond(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for provider, rows in batch.groupby("provider", dropna=False, sort=False):
                out = rows[["task_id", "provider"]].copy()
                try:
                    out["answer"], out["error"] = known[provider](rows), None
                except Exception as why:  # a provider may fail in any way, its tasks must stay
                    out["answer"], out["error"] = None, f"{type(why).__name__}: {why}"[:200]
                yield out

    return tasks.select("task_id", "provider", "input").mapInPandas(respond, "task_id bigint, provider string, answer string, error string")


def fan_out(truths: DataFrame, models: list[tuple[str, str]]) -> DataFrame:
    """Every truth once per model of a short list, in its order."""
    pairs = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model"), F.lit(i).alias("model_no")) for i, (p, m) in enumerate(models)])
    return truths.withColumn("_m", F.explode(pairs)).select("*", "_m.*").drop("_m")


#: Answers of the mock provider by scenario.
MOCK_ANSWERS = {
    "correct": {"drug_name": "시험정", "drug_code": "ITEM-0001", "front_imprint": "AB10", "back_imprint": "20", "shape": "타원형", "color": "하양", "confidence": 95, "evidence": "both imprints and the shape agree", "uncertainty": ""},
    "partial": {"drug_name": "시험", "drug_code": "", "front_imprint": "AB1O", "back_imprint": "20", "shape": "타원형", "color": "하양", "confidence": 62, "evidence": "one imprint agrees", "uncertainty": "the name is not certain"},
    "wrong": {"drug_name": "다른정", "drug_code": "ITEM-9999", "front_imprint": "ZZ", "back_imprint": "", "shape": "원형", "color": "노랑", "confidence": 81, "evidence": "a guess", "uncertainty": ""},
}


def mock(scenario: str = "correct", answers: dict[str, dict] | None = None, delay_s: float = 0.0, message: str = "mock failure") -> Callable[[pd.DataFrame], list[str]]:
    """A provider that gives every input the answer of a scenario: correct, partial, wrong, slow (correct, after ``delay_s``) or error.

    ``answers`` adds or replaces scenarios; one that is not known fails like ``error``.
    """
    known = MOCK_ANSWERS | (answers or {})

    def respond(rows: pd.DataFrame) -> list[str]:
        if scenario == "error":
            raise RuntimeError(message)
        if scenario == "slow":
            time.sleep(delay_s)
        name = "correct" if scenario == "slow" else scenario
        if name not in known:
            raise ValueError(f"unknown scenario {scenario!r}")
        return [json.dumps(known[name], ensure_ascii=False)] * len(rows)

    return respond
