"""Prompt and narrative rendering as column expressions.

Texts are built by ``format_string`` / ``concat_ws`` inside the JVM. A ring prompt is emitted as a
table of lines (header, one line per member, one line per member transaction) keyed by ring and a
sort key: concatenating a ring with a third of all users into one value would put the whole ring
into one task, so only rings up to a stated number of lines are also given as single strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskstream.functions import epoch_ms

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical texts.
TRANSACTION_PROMPT = (
    "Analyze the following transaction for potential fraud:\n\n"
    "TRANSACTION DETAILS:\n"
    "- Transaction ID: %s\n"
    "- User ID: %s\n"
    "- Amount: %s %s\n"
    "- Timestamp: %s\n"
    "- Merchant: %s\n"
    "- Location: %s\n"
    "- Device ID: %s\n"
    "- IP Address: %s\n\n"
    "RULE-BASED SCORES:\n"
    "%s\n\n"
    "ML MODEL SCORE: %s\n\n"
    "Please provide your fraud risk assessment."
)
RULE_LINE = "  - %s: %s"
RING_HEADER = [
    "Analyze the following potential fraud ring:",
    "",
    "RING DETAILS:",
    "- Ring ID: %s",
    "- Shared Resource Type: %s",
    "- Shared Resource ID: %s",
    "- Number of Members: %s",
    "- Member User IDs:",  # followed by the member lines (one id per line, see module doc)
]
RING_TRAILER = [
    "- Total Transaction Amount: %s",
    "- Risk Score: %s",
    "- Detected At: %s",
    "",
    "MEMBER TRANSACTIONS:",
]
RING_TX_LINE = "  - TX %s: user=%s, amount=%s %s, merchant=%s, time=%s, device=%s, ip=%s"
RING_NO_TX = "  No transactions available"
RING_CLOSE = "Please provide your fraud ring investigation analysis."
RING_DISABLED = ("LLM analysis disabled. Fraud ring %s detected with %s members sharing %s '%s'. "
                 "Risk score: %s. Total amount: %s.")
# ---------------------------------------------------------------------------


def fixed(x: Column, digits: int) -> Column:
    """Python ``format(x, '.Nf')`` without thousands separators."""
    return F.regexp_replace(F.format_number(x.cast("double"), digits), ",", "")


def iso_time(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def py_float_str(x: Column) -> Column:
    """str(float) as Python prints it: plain digits for magnitudes from 1e-4 up to 1e16, else an exponent of two digits at
    least. Both print the shortest digits that read back as the same double."""
    d = x.cast("double")
    s = d.cast("string")
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.substring_index(s, "E", -1).try_cast("int")
    exponent = F.concat(F.regexp_replace(F.substring_index(s, "E", 1), r"\.0$", ""),
                        F.when(power < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(power)))
    return (F.when(~s.contains("E"), s)
            .when((F.abs(d) >= 1e-4) & (F.abs(d) < 1e16), plain).otherwise(exponent))


def rule_score_map(reasons: Column) -> Column:
    """Reason texts -> {text before the first ':' (trimmed): 1.0}; of equal names one is left, at the first's place."""
    parts = F.transform(reasons, lambda r: F.split(r, ":", 2))
    names = F.array_distinct(F.transform(F.filter(parts, lambda p: F.size(p) == 2), lambda p: F.trim(p[0])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.lit(1.0)))


def rules_text(m: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.format_string(
        RULE_LINE, e["key"], fixed(e["value"], 3))), "\n")


def transaction_prompt(tx: DataFrame, reasons_col: str = "reasons", ml_score_col: str | None = None) -> DataFrame:
    """One prompt per row of ``tx`` (TRANSACTION columns plus a reasons array)."""
    ml = F.col(ml_score_col) if ml_score_col else F.lit(0.0)
    text = F.format_string(
        TRANSACTION_PROMPT, F.col("transaction_id"), F.col("user_id"), py_float_str(F.col("amount")),
        F.col("currency"), iso_time("event_time"), F.col("merchant_id"), F.col("location"), F.col("device_id"),
        F.col("ip_address"), rules_text(rule_score_map(F.col(reasons_col))), fixed(ml, 3))
    return tx.select("transaction_id", text.alias("prompt"))


def ring_prompt_lines(rings: DataFrame, members: DataFrame, tx: DataFrame, detected_at: Column) -> DataFrame:
    """Prompt lines per ring: (ring_id, part, k1, k2, line). Order within a ring is
    (part, k1, k2): 0 header, 1 member ids (by first use), 2 trailer, 3 transactions (by time, id), 4 close.

    ``rings`` = fraud_rings output, ``members`` = ring_members output, ``tx`` = transactions."""
    r = rings.select("ring_id", "shared_resource_type", "shared_resource_id", "n_users", "risk_score",
                     "total_transaction_amount", detected_at.alias("_detected"))
    head_vals = [None, None, None, F.col("ring_id"), F.col("shared_resource_type"), F.col("shared_resource_id"),
                 F.col("n_users").cast("string"), None]
    head = F.array(*[F.struct(F.lit(i).cast("bigint").alias("k1"),
                              (F.format_string(t, v) if v is not None else F.lit(t)).alias("line"))
                     for i, (t, v) in enumerate(zip(RING_HEADER, head_vals))])
    trail_vals = [fixed(F.col("total_transaction_amount"), 2), fixed(F.col("risk_score"), 3), F.col("_detected"),
                  None, None]
    trail = F.array(*[F.struct(F.lit(i).cast("bigint").alias("k1"),
                               (F.format_string(t, v) if v is not None else F.lit(t)).alias("line"))
                      for i, (t, v) in enumerate(zip(RING_TRAILER, trail_vals))])
    fixed_lines = r.select("ring_id", F.inline(head)).select("ring_id", F.lit(0).alias("part"), "k1",
                                                               F.lit("").alias("k2"), "line").unionByName(
        r.select("ring_id", F.inline(trail)).select("ring_id", F.lit(2).alias("part"), "k1", F.lit("").alias("k2"), "line")
    ).unionByName(r.select("ring_id", F.lit(4).alias("part"), F.lit(0).cast("bigint").alias("k1"),
                           F.lit("").alias("k2"), F.lit(RING_CLOSE).alias("line")))
    member_lines = members.select("ring_id", F.lit(1).alias("part"), F.col("first_use").alias("k1"),
                                  F.col("user_id").alias("k2"), F.concat(F.lit("    "), F.col("user_id")).alias("line"))
    res = F.array(F.struct(F.lit("device").alias("t"), F.col("device_id").alias("id")),
                  F.struct(F.lit("ip").alias("t"), F.col("ip_address").alias("id")))
    t = tx.select("*", F.inline(res))
    line = F.format_string(RING_TX_LINE, F.col("transaction_id"), F.col("user_id"), py_float_str(F.col("amount")),
                           F.col("currency"), F.col("merchant_id"), iso_time("event_time"), F.col("device_id"),
                           F.col("ip_address"))
    tx_lines = t.join(r.select("ring_id", F.col("shared_resource_type").alias("t"), F.col("shared_resource_id").alias("id")),
                      ["t", "id"]).select("ring_id", F.lit(3).alias("part"), epoch_ms("event_time").alias("k1"),
                                          F.col("transaction_id").alias("k2"), line.alias("line"))
    with_tx = tx_lines.select("ring_id").distinct()
    none = r.join(with_tx, "ring_id", "left_anti").select(
        "ring_id", F.lit(3).alias("part"), F.lit(0).cast("bigint").alias("k1"), F.lit("").alias("k2"),
        F.lit(RING_NO_TX).alias("line"))
    return fixed_lines.unionByName(member_lines).unionByName(tx_lines).unionByName(none)


#: Lines of a ring that become one prompt; a larger ring's prompt is read from its lines.
PROMPT_LINES = 10_000


def ring_prompts(lines: DataFrame, max_lines: int = PROMPT_LINES) -> DataFrame:
    """One prompt per ring of at most ``max_lines`` lines, from :func:`ring_prompt_lines`: (ring_id, n_lines, prompt).

    Member ids stand on one line, divided by commas. Every ring has a row; that of a larger one has a null prompt. Lines are
    counted first, so those of a large ring are dropped before any is gathered. Null members or texts are left out."""
    sizes = lines.groupBy("ring_id").agg(F.count(F.lit(1)).alias("n_lines"))
    small = lines.join(sizes.where(F.col("n_lines") <= max_lines).select("ring_id"), "ring_id", "left_semi")
    rows = F.array_sort(F.collect_list(F.struct("part", "k1", "k2", "line")))
    parts = small.groupBy("ring_id").agg(rows.alias("rows"))

    def of(part: int, sep: str) -> Column:
        return F.array_join(F.transform(F.filter("rows", lambda r: r["part"] == part), lambda r: r["line"]), sep)

    ids = F.array_join(F.transform(F.filter("rows", lambda r: r["part"] == 1), lambda r: r["line"].substr(F.lit(5), F.length(r["line"]))), ", ")
    text = F.concat(of(0, "\n"), F.lit(" "), ids, F.lit("\n"), of(2, "\n"), F.lit("\n"), of(3, "\n"), F.lit("\n\n"), of(4, "\n"))
    return sizes.join(parts.select("ring_id", text.alias("prompt")), "ring_id", "left")


def ring_narrative(rings: DataFrame) -> DataFrame:
    """The deterministic narrative used when no language model is configured."""
    text = F.format_string(RING_DISABLED, F.col("ring_id"), F.col("n_users").cast("string"),
                           F.col("shared_resource_type"), F.col("shared_resource_id"),
                           fixed(F.col("risk_score"), 3), fixed(F.col("total_transaction_amount"), 2))
    return rings.select("ring_id", text.alias("narrative"))
