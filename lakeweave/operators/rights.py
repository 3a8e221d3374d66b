"""Rights over data assets: what a right allows, protocols and their constraints, negotiation events, standards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import literal_map
from . import governance

# What each right allows besides queries.
ALLOWED = {
    "read_only": (),
    "analytics": ("api",),
    "derived_work": ("download", "api"),
    "full_access": ("download", "export", "api"),
    "exclusive": ("download", "export", "api"),
}
# Privacy budget by sensitivity, and what else each protocol is held to (as JSON).
EPSILON = {"low": 2.0, "medium": 1.0, "high": 0.5, "critical": 0.1}
CONSTRAINTS = {
    "mpc": '{"min_participants":2,"corruption_threshold":1,"protocol":"SPDZ"}',
    "tee": '{"attestation_required":true,"secure_boot":true,"min_tee_version":"v2.0","allowed_platforms":["Intel_SGX","ARM_TrustZone","AWS_Nitro"]}',
    "federated": '{"min_clients":3,"aggregation_algorithm":"FedAvg","local_epochs":5,"secure_aggregation":true}',
    "raw": '{"max_access_duration":3600,"audit_level":"comprehensive","require_approval":true}',
}
VERIFICATION = {"tee": "tee_attestation", "mpc": "protocol_verification", "federated": "secure_aggregation_audit", "differential_privacy": "noise_verification", "raw": "comprehensive_audit"}
#: Of each protocol, (data exposure, precision, overhead).
METHODS = {"mpc": ("none", "exact", "very_high"), "tee": ("encrypted", "exact", "medium"), "federated": ("none", "high", "high"), "differential_privacy": ("aggregated", "noisy", "low")}
OVERHEAD_POINTS = {"low": 30, "medium": 20, "high": 10, "very_high": 0}
#: Words that a standard looks for in a record, and the finding.
STANDARD_WORDS = {
    "GDPR": {"sensitive_personal_data": ("health", "biometric", "genetic")},
    "HIPAA": {"protected_health_information": ("diagnosis", "treatment", "patient", "medical_record")},
    "CCPA": {"consumer_data": ("consumer", "california")},
}
IDENTIFIERS = ("name", "email", "phone", "address")


def allows(right: Column, access: Column) -> Column:
    """Whether a right allows a kind of access: queries always; unknown rights and kinds as read-only."""
    pairs = {f"{r}/{a}": True for r, kinds in ALLOWED.items() for a in kinds}
    asked = access.isin("download", "export", "api")
    return ~asked | F.coalesce(F.try_element_at(literal_map(pairs), F.concat_ws("/", right, access)), F.lit(False))


def may_write(right: Column, operation: Column) -> Column:
    """SELECT always; other operations for full and exclusive rights alone."""
    return (F.upper(operation) == "SELECT") | right.isin("full_access", "exclusive")


def access_rows(requests: DataFrame, right: str, access: str) -> DataFrame:
    """An audit row for every request: ``allowed``, and why not."""
    ok = allows(F.col(right), F.col(access))
    return requests.withColumn("allowed", ok).withColumn("reason", F.when(~ok, F.concat(F.lit("right doesn't allow "), F.col(access))))


def anonymized(rows: DataFrame, level: str, sensitive: list[str], quasi: dict[str, Column], k: int = 5, noisy: tuple[str, ...] = (), epsilon: float = 1.0, key: str | None = None, seed: int = 0) -> DataFrame:
    """L1 as it is; L2 pseudonyms for ``sensitive``; L3 k-anonymity over ``quasi``; L4 Laplace noise on ``noisy`` by ``key``."""
    if level == "L1":
        return rows
    if level == "L2":
        return governance.pseudonymize(rows, *sensitive)
    if level == "L3":
        return governance.k_anonymize(rows, quasi, k)
    if level == "L4":
        return rows.withColumns({c: governance.laplace(F.col(c), epsilon, 1.0, seed, *([F.col(key)] if key else [])) for c in noisy})
    raise ValueError(f"unknown level {level}")


def constraints(method: Column, sensitivity: Column) -> Column:
    """What a protocol is held to, as JSON; the privacy budget of differential privacy by sensitivity."""
    budget = F.coalesce(F.try_element_at(literal_map(EPSILON), sensitivity), F.lit(2.0))
    noise = F.concat(F.lit('{"epsilon":'), budget.cast("string"), F.lit(',"delta":1.0E-5,"noise_mechanism":"gaussian"}'))
    return F.when(method == "differential_privacy", noise).otherwise(F.coalesce(F.try_element_at(literal_map(CONSTRAINTS), method), F.lit("{}")))


def verification(method: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(VERIFICATION), method), F.lit("third_party_audit"))


def buyer_share(method: Column) -> Column:
    """The buyer's part of the cost; the seller has the rest."""
    return F.when(method.isin("mpc", "federated"), 0.8).otherwise(0.7)


def simple_scores(requests: DataFrame, sensitivity: str, precision: str) -> DataFrame:
    """Every protocol with a score for each request: 50 for no exposure of highly sensitive data, 30 for exact results
    where asked, and up to 30 for low overhead."""
    rows = [F.struct(F.lit(m).alias("method"), F.lit(e).alias("exposure"), F.lit(p).alias("precise"), F.lit(OVERHEAD_POINTS[o]).alias("points")) for m, (e, p, o) in METHODS.items()]
    out = requests.withColumn("_m", F.explode(F.array(*rows)))
    score = F.when(F.col(sensitivity).isin("high", "critical") & (F.col("_m.exposure") == "none"), 50).otherwise(0)
    score = score + F.when((F.col(precision) == "exact") & (F.col("_m.precise") == "exact"), 30).otherwise(0) + F.col("_m.points")
    return out.select(*requests.columns, F.col("_m.method").alias("method"), score.alias("score"))


def findings(record: Column, fields: Column, standard: str) -> Column:
    """What a standard finds in a record (text) with these field names."""
    out = [F.when(F.arrays_overlap(fields, F.array(*map(F.lit, IDENTIFIERS))), "direct_identifiers")] if standard == "GDPR" else []
    for name, words in STANDARD_WORDS[standard].items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(record), F.lit(w))
        out.append(F.when(hit, name))
    return F.array_compact(F.array(*out))


def asset_registrations(assets: DataFrame, owner: str, asset: str, content: Column) -> DataFrame:
    """A register event for every asset, with the hash of its content as the head of its processing chain."""
    return assets.select(F.col(asset).alias("asset"), F.col(owner).alias("owner"), F.lit("DATA_ASSET_REGISTER").alias("event_type"), F.sha2(F.concat(F.lit("0|"), content), 256).alias("chain_hash"))


def rights_states(events: DataFrame, session: str, order: list[str], kind: str, price: str, rights: str) -> DataFrame:
    """Negotiations over rights from their events, in order: state, the price and the rights last named, rounds.

    An offer opens or reopens a negotiation, a counter answers one that is open, a grant closes it, a revocation ends a
    grant. Events out of turn are counted and change nothing. A negotiation's events meet in one row.
    """
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(kind).alias("kind"), F.col(price).cast("double").alias("price"), F.col(rights).alias("rights"))))
    start = F.struct(F.lit("none").alias("state"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("string").alias("rights"), F.lit(0).alias("rounds"), F.lit(0).alias("ignored"))

    def step(s: Column, e: Column) -> Column:
        offer = (e["kind"] == "OFFER") & s["state"].isin("none", "offered", "countered")
        counter = (e["kind"] == "COUNTER") & s["state"].isin("offered", "countered")
        grant = (e["kind"] == "GRANT") & s["state"].isin("offered", "countered")
        revoke = (e["kind"] == "REVOKE") & (s["state"] == "granted")
        taken = offer | counter | grant | revoke
        state = F.when(offer, "offered").when(counter, "countered").when(grant, "granted").when(revoke, "revoked").otherwise(s["state"])
        return F.struct(
            state.alias("state"), F.when(offer | counter, e["price"]).otherwise(s["price"]).alias("price"), F.when(offer | counter | grant, F.coalesce(e["rights"], s["rights"])).otherwise(s["rights"]).alias("rights"),
            (s["rounds"] + F.when(offer | counter, 1).otherwise(0)).alias("rounds"), (s["ignored"] + F.when(taken, 0).otherwise(1)).alias("ignored"),
        )

    return events.groupBy(session).agg(packed.alias("_e")).select(session, F.inline(F.array(F.aggregate("_e", start, step))))
