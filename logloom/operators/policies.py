"""Alert policies: defaults, validated updates, storage."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logloom.functions.json_text import js_trim, json_kind, text_to_boolean, with_parsed

# Number fields with default and minimum.
NUMBER_FIELDS = {
    "intervalMs": (30_000, 1_000),
    "windowMinutes": (5, 1),
    "errorThreshold": (20, 1),
    "noLogsThresholdMinutes": (0, 0),
    "cooldownMs": (300_000, 1_000),
    "webhookTimeoutMs": (5_000, 250),
    "webhookRetryAttempts": (3, 1),
    "webhookBackoffMs": (250, 25),
}
INTEGER_FIELDS = {"webhookRetryAttempts"}
POLICY_FIELDS = ["enabled", "webhookUrl", *NUMBER_FIELDS]

_POLICY_TYPES = {"enabled": "boolean", "webhookUrl": "string", "webhookRetryAttempts": "int"}
POLICY_DDL = "policy_id string, " + ", ".join(f"{f} {_POLICY_TYPES.get(f, 'double')}" for f in POLICY_FIELDS)
MASK = "[configured]"


@dataclass(frozen=True)
class AlertPolicy:
    """Settings of one policy; names follow the stored fields."""

    enabled: bool
    webhookUrl: str | None
    intervalMs: float
    windowMinutes: float
    errorThreshold: float
    noLogsThresholdMinutes: float
    cooldownMs: float
    webhookTimeoutMs: float
    webhookRetryAttempts: int
    webhookBackoffMs: float
    policy_id: str = "default"


def create_policy(policy_id: str = "default", webhook_url: str | None = None, **options: float) -> AlertPolicy:
    """A policy from options: unusable numbers take the default, low ones rise to the minimum."""
    url = (webhook_url or "").strip() or None
    numbers = {}
    for name, (default, minimum) in NUMBER_FIELDS.items():
        value = options.get(name, default)
        usable = isinstance(value, (int, float)) and math.isfinite(value) and value >= 0
        number = max(minimum, value if usable else default)
        numbers[name] = int(number) if name in INTEGER_FIELDS else float(number)
    return AlertPolicy(enabled=url is not None, webhookUrl=url, policy_id=policy_id, **numbers)


def policy_frame(spark: SparkSession, policies: list[AlertPolicy]) -> DataFrame:
    columns = ["policy_id", *POLICY_FIELDS]
    return spark.createDataFrame([tuple(asdict(p)[c] for c in columns) for p in policies], POLICY_DDL)


def _number(value: Column, kind: Column) -> Column:
    """Number a JSON scalar converts to; NULL if it is none."""
    text = js_trim(value.cast("string"))
    decimal = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    number = (
        F.when(kind == "VOID", F.lit(0.0))
        .when(kind == "BOOLEAN", value.cast("boolean").cast("int").cast("double"))
        .when((kind == "STRING") & (text == ""), F.lit(0.0))
        .when((kind == "STRING") & text.rlike(decimal), text.try_cast("double"))
        .when(kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE"), value.cast("double"))
    )
    return F.when(F.abs(number) < float("inf"), number)


def parse_policy_updates(updates: DataFrame, allow_empty: bool = False, label: str = "Alert config payload") -> DataFrame:
    """Validate JSON ``payload`` of each update.

    Adds ``given`` (names of the fields present), one ``u_<field>`` column per policy field
    and ``problem``, the first thing wrong with the payload or NULL.
    """
    parsed = with_parsed(updates.withColumn("payload", js_trim(F.col("payload"))), "payload", "_parsed")
    typed = (
        parsed.withColumn("_members", F.try_variant_get("_parsed", "$", "map<string,variant>"))
        .drop("_parsed")
        .withColumn("_kinds", F.transform_values("_members", lambda _, value: json_kind(value)))
        .withColumn("given", F.coalesce(F.map_keys("_members"), F.array().cast("array<string>")))
    )

    def kind(name: str) -> Column:
        return F.coalesce(F.try_element_at("_kinds", F.lit(name)), F.lit("ABSENT"))

    def value(name: str) -> Column:
        return F.try_element_at("_members", F.lit(name))

    def present(name: str) -> Column:
        return F.array_contains("given", name)

    enabled = F.when(kind("enabled") == "BOOLEAN", value("enabled").cast("boolean")).when(
        kind("enabled") == "STRING", text_to_boolean(value("enabled").cast("string"))
    )
    url = F.when(kind("webhookUrl") == "STRING", F.nullif(js_trim(value("webhookUrl").cast("string")), F.lit("")))
    numbers = {}
    for name in NUMBER_FIELDS:
        number = _number(value(name), kind(name))
        if name in INTEGER_FIELDS:
            number = F.signum(number) * F.floor(F.abs(number))
        numbers[name] = number
    typed = typed.withColumns(
        {"u_enabled": enabled, "u_webhookUrl": url, **{f"u_{name}": number for name, number in numbers.items()}}
    )

    unknown = F.array_except("given", F.array(*[F.lit(name) for name in POLICY_FIELDS]))
    problem = (
        F.when(F.col("_members").isNull(), F.lit(f"{label} must be a JSON object."))
        .when(F.size(unknown) > 0, F.concat(F.lit(f'{label} includes unsupported field "'), unknown[0], F.lit('".')))
        .when(present("enabled") & F.col("u_enabled").isNull(), F.lit("enabled must be a boolean."))
        .when(
            present("webhookUrl") & ~kind("webhookUrl").isin("STRING", "VOID"),
            F.lit("webhookUrl must be a string or null."),
        )
    )
    for name, (_, minimum) in NUMBER_FIELDS.items():
        problem = problem.when(
            present(name) & F.col(f"u_{name}").isNull(), F.lit(f"{name} must be a finite number.")
        ).when(
            present(name) & (F.col(f"u_{name}") < minimum),
            F.lit(f"{name} must be greater than or equal to {minimum}."),
        )
    if not allow_empty:
        problem = problem.when(
            F.size("given") == 0, F.lit("Alert config payload must include at least one updatable field.")
        )
    return typed.withColumn("problem", problem).drop("_members", "_kinds")


def apply_policy_updates(policies: DataFrame, parsed: DataFrame) -> DataFrame:
    """Policies after their parsed updates, one row each, with ``applied`` and ``problem`` of the last one.

    Several updates of a policy go in the order of column ``seq`` (without it, in that of their content), each
    checked against the state that the earlier ones left. An update that is invalid, or would enable alerts
    without a webhook, changes nothing. ``updates`` and ``applied_updates`` count them.
    """
    order = (F.col("seq") if "seq" in parsed.columns else F.lit(0)).cast("bigint").alias("seq")
    own = [f"u_{name}" for name in POLICY_FIELDS]
    steps = parsed.groupBy("policy_id").agg(F.sort_array(F.collect_list(F.struct(order, "given", "problem", *own))).alias("_steps"))
    types = {name: _POLICY_TYPES.get(name, "double") for name in POLICY_FIELDS}
    start = F.struct(
        *[F.col(name).cast(types[name]).alias(name) for name in POLICY_FIELDS],
        F.lit(False).alias("applied"),
        F.lit(None).cast("string").alias("problem"),
        F.lit(0).cast("bigint").alias("applied_updates"),
    )

    def step(state: Column, update: Column) -> Column:
        def present(name: str) -> Column:
            return F.array_contains(update["given"], name)

        def chosen(name: str) -> Column:
            return F.when(present(name), update[f"u_{name}"]).otherwise(state[name])

        url = chosen("webhookUrl")
        enabled = (
            F.when(present("enabled"), update["u_enabled"])
            .when(present("webhookUrl"), update["u_webhookUrl"].isNotNull())
            .otherwise(state["enabled"])
        )
        no_url = F.when(enabled & url.isNull(), F.lit("webhookUrl must be configured when alerting is enabled."))
        problem = F.coalesce(update["problem"], no_url)
        after = {"enabled": enabled, "webhookUrl": url, **{name: chosen(name) for name in NUMBER_FIELDS}}
        return F.struct(
            *[F.when(problem.isNull(), after[f]).otherwise(state[f]).cast(types[f]).alias(f) for f in POLICY_FIELDS],
            problem.isNull().alias("applied"),
            problem.alias("problem"),
            (state["applied_updates"] + F.when(problem.isNull(), 1).otherwise(0)).alias("applied_updates"),
        )

    joined = policies.join(steps, "policy_id", "left")
    none = F.array().cast(steps.schema["_steps"].dataType)
    final = joined.select("policy_id", F.coalesce(F.size("_steps"), F.lit(0)).cast("bigint").alias("updates"), F.aggregate(F.coalesce("_steps", none), start, step).alias("_state"))
    fields = [F.col(f"_state.{name}").alias(name) for name in (*POLICY_FIELDS, "applied", "problem", "applied_updates")]
    return final.select("policy_id", *fields, F.when(F.col("updates") > 0, F.col("updates")).otherwise(0).alias("updates"))


def masked(policies: DataFrame) -> DataFrame:
    return policies.withColumn("webhookUrl", F.when(F.col("webhookUrl").isNotNull(), F.lit(MASK)))


def persist_policies(policies: DataFrame, path: str) -> None:
    """Store policies as JSON text, one row per policy."""
    policies.select("policy_id", F.to_json(F.struct(*POLICY_FIELDS)).alias("payload")).write.mode("overwrite").parquet(
        path
    )


def load_policies(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """Stored policies (policy_id, payload) applied over defaults."""
    parsed = parse_policy_updates(stored, allow_empty=True, label="Persisted alert config")
    return apply_policy_updates(defaults, parsed)
