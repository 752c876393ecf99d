"""Field extraction: context, prompts, the model stage and its outcome."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fieldloom.functions import answers, text as tx
from fieldloom.operators.changes import last_change
from fieldloom.plans.order import cut_lineage

MAX_PROMPT, MAX_CONTEXT = 10_000, 200_000


def dependency_context(jobs: DataFrame, edges: DataFrame, extractions: DataFrame) -> DataFrame:
    """Jobs (source_id, prompt_id) with ``context`` map and ``missing`` required keys."""
    values = extractions.where(F.col("validated_result") != "").select(
        "source_id", F.col("prompt_id").alias("depends_on"), F.col("validated_result").alias("_value"))
    needed = jobs.select("source_id", "prompt_id").join(edges, "prompt_id").join(values, ["source_id", "depends_on"], "left")
    # A group has one row per declared dependency of a prompt.
    pairs = F.collect_list(F.when(F.col("_value").isNotNull(), F.struct("context_key", "_value")))
    gaps = F.collect_list(F.when(F.col("_value").isNull() & F.col("is_required"), F.col("context_key")))
    found = needed.groupBy("source_id", "prompt_id").agg(
        F.map_from_entries(F.array_sort(pairs)).alias("context"), F.array_sort(gaps).alias("missing"))
    return jobs.join(found, ["source_id", "prompt_id"], "left").withColumn(
        "context", F.coalesce("context", F.create_map().cast("map<string,string>"))
    ).withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def dependency_waves(prompts: DataFrame, edges: DataFrame) -> DataFrame:
    """Wave per prompt: one more than its latest dependency within the same set.

    ``prompts``: set_id, prompt_id.  ``edges``: set_id, prompt_id, depends_on.
    Prompts that wait for a cycle share one last wave of their set.  One round per
    wave; every round is stored, so the plan does not grow with the depth.
    """
    inside = edges.join(prompts.select("set_id", F.col("prompt_id").alias("depends_on")), ["set_id", "depends_on"], "left_semi")
    state = cut_lineage(prompts.select("set_id", "prompt_id", F.lit(None).cast("int").alias("wave")))
    inside = cut_lineage(inside.select("set_id", "prompt_id", "depends_on"))
    number = 0
    while not state.where("wave IS NULL").isEmpty():
        number += 1
        left = state.where("wave IS NULL").select("set_id", "prompt_id")
        waiting = inside.join(left.withColumnRenamed("prompt_id", "depends_on"), ["set_id", "depends_on"], "left_semi")
        ready = left.join(waiting.select("set_id", "prompt_id").distinct(), ["set_id", "prompt_id"], "left_anti")
        stuck = left.join(ready.select("set_id").distinct(), "set_id", "left_anti")
        now = ready.unionByName(stuck).withColumn("_now", F.lit(number))
        state = cut_lineage(
            state.join(now, ["set_id", "prompt_id"], "left").select("set_id", "prompt_id", F.coalesce("wave", "_now").alias("wave")))
    return state


def inject_context(prompt: Column, context: Column) -> Column:
    """Replace ``{key}`` by the value of each context entry."""
    return F.aggregate(
        F.map_entries(context), prompt,
        lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
    )


def format_validation(df: DataFrame, prompt: str = "validate_prompt", raw: str = "raw_result", context: str = "context") -> DataFrame:
    """Add ``validate_text`` and ``format_error``.

    Only ``{raw_result}`` may stand in a validation prompt when it is filled;
    doubled braces are literal and context keys are replaced afterwards.
    """
    masked = F.replace(F.replace(F.col(prompt), F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    names = F.regexp_extract_all(F.col("_masked"), F.lit(r"\{([^{}]*)\}"), F.lit(1))
    unknown = F.element_at(F.filter(names, lambda n: n != "raw_result"), 1)
    stray = F.regexp_replace(F.col("_masked"), r"\{[^{}]*\}", "").rlike(r"[{}]")
    out = df.withColumn("_masked", masked).withColumn("_unknown", F.when(F.size(F.filter(names, lambda n: n != "raw_result")) > 0, unknown))
    error = F.when(F.col("_unknown").isNotNull(), F.concat(F.lit("Prompt format error: '"), F.col("_unknown"), F.lit("'"))).when(
        stray, F.lit("Prompt format error: single brace"))
    filled = F.replace(F.col("_masked"), F.lit("{raw_result}"), F.coalesce(F.col(raw), F.lit("")))
    filled = F.replace(F.replace(filled, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))
    out = out.withColumn("format_error", error).withColumn("_filled", filled)
    return out.withColumn("validate_text", F.when(F.col("format_error").isNull(), inject_context(F.col("_filled"), F.col(context)))).drop(
        "_masked", "_unknown", "_filled")


def compose_message(prompt: Column, context: Column) -> Column:
    """User message within the model's size limits."""
    task, ground = F.substring(prompt, 1, MAX_PROMPT), F.substring(context, 1, MAX_CONTEXT)
    return F.when(
        tx.not_blank(context), F.concat(F.lit("Kontext:\n"), ground, F.lit("\n\nAufgabe:\n"), task)
    ).otherwise(task)


def with_ground(ground: str | None, task: str) -> str:
    """``compose_message`` of a text and a task that are within their sizes."""
    return task if ground is None else f"Kontext:\n{ground}\n\nAufgabe:\n{task}"


def clamp_temperature(value: Column, default: float = 0.3) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.coalesce(value, F.lit(default))))


def read_responses(responses: DataFrame, raw: str = "response") -> DataFrame:
    """Stored model responses: content, confidence, model, tokens or an error."""
    schema = (
        "choices array<struct<message:struct<content:string>,finish_reason:string,"
        "logprobs:struct<token_logprobs:array<double>>>>,model string,usage struct<total_tokens:bigint>"
    )
    parsed = responses.withColumn("_r", F.from_json(raw, schema)).withColumn("_c", F.try_element_at("_r.choices", F.lit(1)))
    message = F.get_json_object(raw, "$.choices[0].message")
    keys = F.json_object_keys(message)
    error = (
        F.when(F.coalesce(F.size("_r.choices"), F.lit(0)) <= 0, "no choices")
        .when(message.isNull(), "no message")
        .when(~F.array_contains(keys, "content"), "no content")
    )
    content = F.coalesce(F.col("_c.message.content"), F.lit(""))
    confidence = answers.response_confidence(F.col("_c.finish_reason"), F.col("_c.logprobs.token_logprobs"), content)
    out = parsed.withColumn("error", error)
    fine = F.col("error").isNull()
    return out.select(
        *[c for c in responses.columns if c != raw], F.when(fine, content).alias("content"), F.when(fine, confidence).alias("confidence"),
        F.col("_r.model").alias("model"), F.col("_r.usage.total_tokens").alias("tokens"), "error")


def extraction_outcome(df: DataFrame) -> DataFrame:
    """Stored columns from the two stages.

    Input: raw_result, raw_confidence, extract_error, format_error, quality, score,
    notes, result, validate_error.  A stage that failed leaves INSUFFICIENT and 0.
    """
    failed = F.col("extract_error").isNotNull()
    empty = ~failed & (F.coalesce("raw_result", F.lit("")) == "")
    broken = F.coalesce("format_error", "validate_error")
    bad = failed | empty | broken.isNotNull()
    note = (
        F.when(failed, F.col("extract_error")).when(empty, "Extract phase returned empty result")
        .when(broken.isNotNull(), broken).otherwise(F.col("notes"))
    )
    null = F.lit(None)
    keep = [c for c in df.columns if c in ("source_id", "prompt_id", "extraction_id")]
    return df.select(
        *keep,
        F.when(~(failed | empty), F.col("raw_result")).alias("raw_result"),
        F.when(~failed, F.col("raw_confidence")).alias("raw_confidence"),
        F.when(~bad, F.col("result")).alias("validated_result"),
        F.when(bad, "INSUFFICIENT").otherwise(F.col("quality")).alias("validation_quality"),
        F.when(bad, 0.0).otherwise(F.col("score")).alias("validation_score"),
        note.alias("validation_notes"),
        F.when(bad, 0.0).otherwise(answers.final_confidence(F.col("raw_confidence"), F.col("score"))).alias("final_confidence"),
        F.when(failed, F.col("extract_error")).when(empty, "Empty extraction result").when(broken.isNotNull(), broken).otherwise(null).alias("error"),
    )


def rule_model(batch: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in: the longest line of the context, approved on review."""
    texts, reasons = [], []
    for message in batch["message"]:
        ground, _, task = message.partition("\n\nAufgabe:\n")
        if task.startswith("Check"):
            value = task.partition(": ")[2]
            texts.append(f"QUALITY: HIGH\nSCORE: 0.9\nNOTES: -\nRESULT: {value}")
        else:
            lines = [x.strip() for x in ground.split("\n")[1:] if x.strip()]
            texts.append(max(lines, key=len, default=""))
        reasons.append("stop")
    return pd.DataFrame({"text": texts, "finish_reason": reasons})


def call_model(df: DataFrame, texts: DataFrame, model_fn: Callable[[pd.DataFrame], pd.DataFrame], task: str, prefix: str) -> DataFrame:
    """Ask ``model_fn`` each task of a source together with the source's text; adds <prefix>_text, _reason and _error.

    ``df``: source_id and a task that is null where nothing is to be asked.  ``texts``:
    source_id, markdown.  A source's rows, at most one per field, travel as one, so its text
    is joined once and goes to Python once.  ``model_fn`` gets a frame with ``message``
    and returns ``text`` and ``finish_reason`` per row.  A batch that raises becomes error
    rows instead of a failed job.  Answers may differ from call to call, so Spark is told
    not to repeat or move the call.
    """

    def ask(ground: pd.Series, tasks: pd.Series) -> pd.Series:
        messages = [None if t is None else with_ground(g, t) for g, own in zip(ground, tasks, strict=True) for t in own]
        out = [(None, None, None)] * len(messages)
        asked = [i for i, m in enumerate(messages) if m is not None]
        if asked:
            try:
                got = model_fn(pd.DataFrame({"message": [messages[i] for i in asked]}))
                for i, text, reason in zip(asked, got["text"], got["finish_reason"], strict=True):
                    out[i] = (text, reason, None)
            except Exception as problem:
                for i in asked:
                    out[i] = (None, None, str(problem))
        rows, at = [], 0
        for own in tasks:
            rows.append([dict(zip(("text", "reason", "error"), r, strict=True)) for r in out[at : at + len(own)]])
            at += len(own)
        return pd.Series(rows)

    ask.__annotations__ = {"ground": pd.Series, "tasks": pd.Series, "return": pd.Series}
    answer = F.pandas_udf(ask, "array<struct<text:string,reason:string,error:string>>").asNondeterministic()
    own = [c for c in df.columns if c not in ("source_id", task)]
    grouped = df.groupBy("source_id").agg(F.collect_list(F.struct(*own)).alias("_rows"), F.collect_list(F.struct(F.col(task).alias("t"))).alias("_tasks"))
    ground = F.when(tx.not_blank(F.col("markdown")), F.substring("markdown", 1, MAX_CONTEXT)).alias("_ground")
    joined = grouped.join(texts.select("source_id", ground), "source_id")
    called = joined.select("source_id", "_rows", answer("_ground", F.transform("_tasks", lambda x: F.substring(x["t"], 1, MAX_PROMPT))).alias("_answers"))
    each = called.select("source_id", F.inline(F.arrays_zip("_rows", "_answers")))
    return each.select("source_id", "_rows.*", *[F.col(f"_answers.{c}").alias(f"{prefix}_{c}") for c in ("text", "reason", "error")])


def run_extraction(jobs: DataFrame, model_fn: Callable[[pd.DataFrame], pd.DataFrame] = rule_model, texts: DataFrame | None = None) -> DataFrame:
    """Extract and validate every job.

    ``jobs``: source_id, prompt_id, extract_prompt, validate_prompt, context; ``texts``:
    source_id, markdown, by default the ``markdown`` of a source's jobs.  Rows with a missing
    required dependency still run, as the missing key stays visible.
    """
    if texts is None:
        texts = jobs.select("source_id", "markdown").dropDuplicates(["source_id"])
        jobs = jobs.drop("markdown")
    first = call_model(jobs.withColumn("_task", inject_context(F.col("extract_prompt"), F.col("context"))), texts, model_fn, "_task", "extract")
    no_logs = F.lit(None).cast("array<double>")
    first = first.withColumn("raw_result", F.col("extract_text")).withColumn(
        "raw_confidence", answers.response_confidence(F.col("extract_reason"), no_logs, F.col("extract_text")))
    checked = format_validation(first)
    usable = F.col("extract_error").isNull() & (F.col("raw_result") != "") & F.col("format_error").isNull()
    checked = checked.withColumn("_task", F.when(usable, F.col("validate_text"))).drop("validate_text", "extract_prompt", "validate_prompt", "context", "extract_text")
    second = call_model(checked, texts, model_fn, "_task", "validate")
    parsed = second.withColumn("_v", answers.parse_validation(F.col("validate_text")))
    return extraction_outcome(parsed.select("*", "_v.quality", "_v.score", "_v.notes", "_v.result"))


# --- translation -------------------------------------------------------------

# English names of the language codes.
LANGUAGE_NAMES = {
    "de": "German", "en": "English", "fr": "French", "es": "Spanish",
    "it": "Italian", "nl": "Dutch", "pl": "Polish",
}
# Fixed value: wording of the translation prompt.
TRANSLATION_PROMPT = """Translate this {source_language} text to {target_language}.

CONTEXT: This is the "{field_name}" field from a profile about {category} at a university.
{field_context}
RULES:
- Keep formatting (lists, bullet points, bold, italic)
- Do NOT translate proper names (people, institutions, projects, products)
- Keep URLs and email addresses unchanged
- Keep technical abbreviations (API, LLM, GPT, KI, etc.)
- Keep {source_language} academic terms if no good {target_language} equivalent exists

{source_language} TEXT:
{text}

Respond with ONLY the {target_language} translation, no explanations."""


def translation_prompts(rows: DataFrame, target: str, source: str = "de") -> DataFrame:
    """Prompt, token budget and error per value.

    ``rows``: extraction_id, display_name, category, translation_context, validated_result.
    """
    names = {k: LANGUAGE_NAMES.get(k.lower()) for k in (source, target)}
    unknown = [k for k, v in names.items() if v is None]
    hint = tx.strip(F.coalesce("translation_context", F.lit("")))
    line = F.when(hint != "", F.concat(F.lit('The "'), F.col("display_name"), F.lit('" field means: '), hint, F.lit("\n"))).otherwise("")
    shaped = TRANSLATION_PROMPT.replace("{source_language}", names[source] or "").replace("{target_language}", names[target] or "")
    parts = {"field_name": F.col("display_name"), "category": F.coalesce("category", F.lit("AI initiative")), "field_context": line, "text": F.col("validated_result")}
    pieces, rest = [], shaped
    for key in ("field_name", "category", "field_context", "text"):
        before, _, rest = rest.partition("{" + key + "}")
        pieces += [F.lit(before), parts[key]]
    prompt = F.concat(*pieces, F.lit(rest))
    error = F.lit(f"no language name for code {unknown[0]!r}") if unknown else F.lit(None).cast("string")
    return rows.select(
        "extraction_id", F.when(error.isNull(), prompt).alias("prompt"), (F.length("validated_result") * 2).alias("max_tokens"), error.alias("error"))


def apply_translations(extractions: DataFrame, prompts: DataFrame, results: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """New translation columns: translated, failed or skipped.

    ``results``: extraction_id, answer.  Only rows that are due change.
    """
    flags = prompts.select("prompt_id", F.col("translatable").alias("_ok"))
    last = last_change(results.select("extraction_id", "answer"), ["extraction_id"])
    joined = extractions.join(flags, "prompt_id", "left").join(last, "extraction_id", "left")
    due = (F.col("validated_result") != "") & (F.lit(force) | F.coalesce(F.col("translation_status") == "pending", F.lit(True)))
    skip = F.coalesce(~F.col("_ok"), F.lit(False))
    joined = joined.withColumn("_a", answers.accept_translation(F.col("answer"), F.col("validated_result"))).withColumn(
        "_new", F.when(~F.coalesce(due, F.lit(False)), F.lit(None)).when(skip, "skipped").otherwise(F.col("_a.state")))
    done = F.col("_new") == "translated"
    fresh = {
        "validated_result_en": F.when(done, F.col("_a.text")).otherwise(F.col("validated_result_en")),
        "translation_status": F.coalesce("_new", "translation_status"),
        "translated_at": F.when(done, now).otherwise(F.col("translated_at")),
    }
    return joined.select(*[fresh.get(c, F.col(c)).alias(c) for c in extractions.columns], F.col("_new").alias("outcome"))


def translation_run_stats(applied: DataFrame) -> DataFrame:
    return applied.agg(
        F.count("outcome").alias("total"),
        *[F.count_if(F.col("outcome") == s).alias(s) for s in ("translated", "skipped", "failed")])
