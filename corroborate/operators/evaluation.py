"""A recorded evaluation derived again: from raw responses to validity, metrics and gates.

results: arm_id, model_id (null for the rule arm), conflict_id, status, elapsed_ms, advice (JSON text), advice_sha256, payload (base64
of the raw response), byte_count, response_sha256, error_type. cards: as evidence.conflict_cards().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.document import canonical_sha256, canonical_text
from corroborate.functions.text import canonical_json, fully, is_sha256
from corroborate.operators.evidence import advice_rules, arm_metrics
from corroborate.operators.receipts import arm_differences

# Statuses of a result, errors that need no response, bytes of a response, gates.
VALID, FAILED = "VALID_SHADOW_ADVICE", "FAIL_CLOSED"
TRANSPORT = ("ModelAdapterError", "ModelDisabledError")
MOST_BYTES = 1 << 20
GATES = {"privacy_gate": "HOLD_NOT_TECHNICALLY_DEMONSTRATED", "benefit_gate": "NOT_ASSESSED_NO_INDEPENDENT_HUMAN_TIMING"}
#: Base64 without blanks, with its padding.
_BASE64 = "(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"
_ADVICE = "authority_boundary string, action string, claim_refs array<string>, evidence_refs array<string>, explanation string, questions array<string>"
_FIELDS = sorted(x.split()[0] for x in _ADVICE.split(", "))


def replayed(results: DataFrame, cards: DataFrame) -> DataFrame:
    """``results`` with strict (the payload is base64), response (its bytes), said (the advice in the response, in canonical form) and replays (that advice keeps to its card's rules).

    One join by conflict; a hot conflict's card is one row.
    """
    strict = fully(F.col("payload"), _BASE64)
    rows = results.withColumn("strict", F.coalesce(strict, F.lit(False))).withColumn("response", F.when(F.col("strict"), F.try_to_binary("payload", F.lit("base64"))))
    text = F.decode("response", "UTF-8")
    model = F.get_json_object(text, "$.model")
    said = F.when(model == F.col("model_id"), canonical_text(F.get_json_object(text, "$.choices[0].message.content")))
    rows = rows.withColumn("said", said).join(cards.select("conflict_id", "claim_ids", "evidence", F.lit(True).alias("known")), "conflict_id", "left")
    inner = rows.withColumn("a", F.from_json("said", _ADVICE)).select("*", "a.*")
    fine = F.array_sort(F.json_object_keys("said")) == F.array(*map(F.lit, _FIELDS))
    for rule in advice_rules().values():
        fine = fine & rule
    return inner.withColumn("replays", F.coalesce(fine, F.lit(False))).drop("a", *_FIELDS)


def result_rules() -> dict[str, Column]:
    """Rules of a replayed result, each on its own; True is kept."""
    has, strict, model = F.col("payload").isNotNull(), F.col("strict"), F.col("model_id").isNotNull()
    valid, failed = F.col("status") == VALID, F.col("status") == FAILED
    return {
        "card": F.col("known"), "elapsed_ms": F.col("elapsed_ms") >= 0, "status": valid | failed, "rule_arm": model | ~has, "base64": ~has | strict,
        "byte_count": ~has | ~strict | (F.octet_length("response") == F.col("byte_count")) & (F.col("byte_count") <= MOST_BYTES), "response_sha256": ~has | ~strict | (F.sha2("response", 256) == F.col("response_sha256")) & is_sha256(F.col("response_sha256")),
        "advice_sha256": F.when(valid, F.col("advice_sha256") == canonical_sha256(F.col("advice"))).otherwise(F.col("advice").isNull() & F.col("advice_sha256").isNull()),
        "rederived": ~(valid & model) | F.col("replays") & (F.col("said") == canonical_text(F.col("advice"))), "validates": ~(failed & has) | ~F.col("replays"),
        "transport": ~(failed & model & ~has) | F.col("error_type").isin(*TRANSPORT),
    }


def evaluation_differences(results: DataFrame, cards: DataFrame, recorded: DataFrame, gates: DataFrame) -> DataFrame:
    """(arm_id, conflict_id, rule) of where a record is not what its raw responses give.

    Results against their rules; cards that an arm omits or has twice (``omitted``, ``repeated``); recorded arms (arm_id, results,
    valid, rate) against metrics of the results that replay; ``gates`` (gate, value) against those that follow.
    """
    rows = replayed(results, cards)
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in result_rules().items())))
    found = rows.select("arm_id", "conflict_id", F.explode(broken).alias("rule"))
    counted = results.groupBy("arm_id", "conflict_id").count()
    twice = counted.filter("count > 1").select("arm_id", "conflict_id", F.lit("repeated").alias("rule"))
    per_arm = counted.groupBy("arm_id").agg(F.count(F.lit(1)).alias("n"))
    short = per_arm.join(cards.agg(F.count(F.lit(1)).alias("cards"))).filter("n < cards").select("arm_id")  # one row
    omitted = short.join(cards.select("conflict_id")).join(counted, ["arm_id", "conflict_id"], "left_anti").select("arm_id", "conflict_id", F.lit("omitted").alias("rule"))  # arms are few, and only those that are short
    derived = rows.select("arm_id", ((F.col("status") == VALID) & (F.col("replays") | F.col("model_id").isNull())).alias("valid"))
    none = F.lit(None).cast(cards.schema["conflict_id"].dataType)
    arms = arm_differences(derived, recorded).select("arm_id", none.alias("conflict_id"), F.col("field").alias("rule"))
    safety = arm_metrics(derived).agg(F.when(F.min("rate") == 1.0, "PASS").otherwise("HOLD").alias("value")).select(F.lit("safety_gate").alias("gate"), "value")
    expected = results.sparkSession.createDataFrame(list(GATES.items()), "gate string, value string").unionByName(safety)
    both = expected.join(gates.select("gate", F.col("value").alias("said")), "gate", "full").filter(~F.col("value").eqNullSafe(F.col("said")))
    return found.unionByName(twice).unionByName(omitted).unionByName(arms).unionByName(both.select(F.lit(None).cast("string").alias("arm_id"), none.alias("conflict_id"), F.col("gate").alias("rule")))


def evaluation_id(card_set_sha256: Column, runtime_observations_sha256: Column, model_ids: Column, seed: Column, pre_registration: Column) -> Column:
    """The name of an evaluation: what it was run on and with."""
    return F.concat(F.lit("m5-"), F.sha2(canonical_json(card_set_sha256.alias("card_set_sha256"), F.array_sort(model_ids).alias("model_ids"), pre_registration.alias("pre_registration"), runtime_observations_sha256.alias("runtime_observations_sha256"), seed.alias("seed")), 256))
