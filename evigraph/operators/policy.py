"""Rules over proposals and events: first match, gates, escalation, subscriptions."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import glob_match

# The rules that hold unless a file gives others, in the order in which they are tried.
DEFAULT_RULES = """
[[policy]]
name = "low-confidence-require-peer"
confidence_below = 0.6
decision = "RequireApproval"
level = "PeerApproval"
reason = "low-confidence proposal"

[[policy]]
name = "high-security-impact-require-review"
security_impact = "Critical"
decision = "RequireApproval"
level = "SecurityApproval"
reason = "critical security impact requires security team review"

[[policy]]
name = "tests-in-dev-auto"
command = "run_tests"
environment = "Development"
decision = "Allow"

[[policy]]
name = "tests-in-prod-require-peer"
command = "run_tests"
environment = "Production"
decision = "RequireApproval"
level = "PeerApproval"
reason = "tests on production require peer sign-off"

[[policy]]
name = "modify-source-always-require-tech-lead"
command = "modify_source"
environment = "any"
decision = "RequireApproval"
level = "TechLeadApproval"
reason = "modifying source files requires tech lead"

[[policy]]
name = "deploy-production-always-deny"
command = "deploy_production"
environment = "any"
decision = "Deny"
reason = "production deploys require human + CI"
"""
ENVIRONMENTS = ("Development", "Staging", "Production")
IMPACTS = ("None", "Low", "Medium", "High", "Critical")
RULE_SCHEMA = "nth int, name string, command string, environment string, security_impact string, confidence_below double, cost_above_tokens long, decision string, level string, reason string"


def load_rules(spark: SparkSession, text: str = DEFAULT_RULES) -> DataFrame:
    """Rules as rows in order.  `any` is a wildcard; other unknown values are errors, so that a typo broadens nothing."""
    rows = []
    for i, r in enumerate(tomllib.loads(text).get("policy", [])):
        for name, known in (("environment", ENVIRONMENTS), ("security_impact", IMPACTS)):
            if r.get(name) not in (None, "any", *known):
                raise ValueError(f"rule {r['name']}: unknown {name} {r[name]}")
        of = lambda k, r=r: None if r.get(k) == "any" else r.get(k)
        rows.append((i, r["name"], r.get("command"), of("environment"), of("security_impact"), r.get("confidence_below"), r.get("cost_above_tokens"), r["decision"], r.get("level"), r.get("reason")))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def evaluate(proposals: DataFrame, rules: DataFrame) -> DataFrame:
    """Proposals (id, command, environment, security_impact, confidence, tokens) with the decision of the first rule
    all of whose fields match.  No confidence counts as 0; tokens must exceed their limit; no rule: peer approval.

    Rules are a file's worth of rows, so they are tried as one array in each row; proposals are not shuffled.
    """
    table = rules.agg(F.sort_array(F.collect_list(F.struct(*rules.columns))).alias("rules"))
    p = proposals.join(F.broadcast(table), F.lit(True))  # one row

    def fits(r):
        same = lambda field, value: r[field].isNull() | F.coalesce(r[field] == value, F.lit(False))
        sure = r["confidence_below"].isNull() | (F.coalesce(F.col("confidence"), F.lit(0.0)) < r["confidence_below"])
        dear = r["cost_above_tokens"].isNull() | (F.coalesce(F.col("tokens"), F.lit(0)) > r["cost_above_tokens"])
        return same("command", F.col("command")) & same("environment", F.col("environment")) & same("security_impact", F.col("security_impact")) & sure & dear

    first = F.get(F.filter("rules", fits), F.lit(0))
    p = p.withColumn("rule", first)
    none = F.col("rule").isNull()
    return p.select(
        *proposals.columns, F.col("rule.name").alias("matched_rule"), F.when(none, "RequireApproval").otherwise(F.col("rule.decision")).alias("decision"),
        F.when(none, "PeerApproval").otherwise(F.col("rule.level")).alias("level"), F.when(none, "no policy rule matched").otherwise(F.col("rule.reason")).alias("reason"),
    )


def gate(decided: DataFrame) -> DataFrame:
    """What happens with a decision: Execute, Queue or Deny; an escalation reports Queue without being queued."""
    action = F.when(F.col("decision").isin("Allow", "AllowWithNotify"), "Execute").when(F.col("decision").isin("RequireApproval", "Escalate"), "Queue").otherwise("Deny")
    return decided.withColumn("action", action).withColumn("queued", F.col("decision") == "RequireApproval")


def approval_queue(log: DataFrame, *, lifetime: str | None = None, now: Column | None = None) -> DataFrame:
    """Proposals still waiting.  log: seq, proposal_id, action (enqueue, approve, reject); each id once, by its first
    enqueue since it was last decided.  With a lifetime an enqueue lapses so long after ``at``; later ones then stand for it.

    Decisions are one aggregate, joined back only to ids that have any; streaming.approvals keeps the same up as events come.
    """
    made = log.filter("action = 'enqueue'")
    if lifetime is not None:
        made = made.filter(F.col("at") + F.expr(f"INTERVAL {lifetime}") > now)
    decided = log.filter(F.col("action").isin("approve", "reject")).groupBy("proposal_id").agg(F.max("seq").alias("decided"))
    waiting = made.join(decided, "proposal_id", "left").filter(F.col("decided").isNull() | (F.col("seq") > F.col("decided")))
    return waiting.groupBy("proposal_id").agg(F.min("seq").alias("seq"))


# Below these confidences the next larger model takes over.
LADDER = ((0.5, "Human"), (0.8, "PowerfulLLM"), (0.95, "LocalLLM"))


def escalate(evidence: DataFrame, ladder: tuple[tuple[float, str], ...] = LADDER) -> DataFrame:
    """(key, min_confidence, model) by the lowest confidence among a key's evidence; without any, no rule fires."""
    g = evidence.groupBy("key").agg(F.min("confidence").alias("min_confidence"))
    model = F.lit("Heuristic")
    for limit, name in reversed(ladder):
        model = F.when(F.col("min_confidence") < limit, name).otherwise(model)
    return g.withColumn("model", model)


def over_budget(tokens, limit):
    """Over only if both are known."""
    return F.coalesce(tokens > limit, F.lit(False))


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(seq, event_type, agent, nth) for every agent with a pattern that fits.  subscriptions: nth, agent, patterns.

    Subscriptions are configuration; they ride along as one array.
    """
    subs = subscriptions.agg(F.sort_array(F.collect_list(F.struct("nth", "agent", "patterns"))).alias("subs"))
    fits = lambda s: F.exists(F.coalesce(s["patterns"], F.array().cast("array<string>")), lambda p: glob_match(p, F.col("event_type")))
    e = events.join(F.broadcast(subs), F.lit(True))
    return e.select("seq", "event_type", F.explode(F.filter("subs", fits)).alias("s")).select("seq", "event_type", "s.agent", "s.nth")


def first_answer(answers: DataFrame) -> DataFrame:
    """Of each event the first answer, by registration, that isn't NoAction: (seq, agent, answer)."""
    a = answers.filter("answer <> 'NoAction'").groupBy("seq").agg(F.min(F.struct("nth", "agent", "answer")).alias("a"))
    return a.select("seq", "a.agent", "a.answer")
