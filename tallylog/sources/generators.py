"""Seeded synthetic logs of four server types, as DataFrames.

Every line draws its kind from a weighted mixture and fills it from hashes of (seed, row), so a row does not depend on
partitioning.  Counters grow by the row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.operators.parsing import format_line

#: The mixtures of the four types.
MIXTURES = {
    "healthcare": {"step_chain": 0.4, "screen": 0.1, "report": 0.3, "regular": 0.2},
    "linux": {"check_pass": 0.25, "auth_fail": 0.35, "session": 0.10, "ftp": 0.15, "su": 0.08, "system": 0.05, "service": 0.02},
    "windows": {"cbs": 0.35, "csi": 0.30, "trusted_installer": 0.15, "sqm": 0.10, "transaction": 0.10},
    "zookeeper": {"quorum": 0.25, "connection": 0.30, "session": 0.20, "worker": 0.15, "notification": 0.10},
}
#: Component, process and message of each kind.  Those that the learner looks for (steps, calories, altitude, SCREEN_ON and SCREEN_OFF, REPORT, "check pass; user unknown") are
#: fixed values; the other wording is our own.  {a}, {b} are numbers, {h} hexadecimal, {ip} an address.
WORDING = {
    "screen": ("Step_ScreenUtil", "", "SCREEN_{toggle}"),
    "report": ("HiH_Report", "", "REPORT : {steps} {a} {b} 240"),
    "regular": ("Step_Standard", "", "flush sensor data totalAltitude={a}"),
    "check_pass": ("combo", "sshd(pam_unix)[{b}]", "check pass; user unknown"),
    "auth_fail": ("combo", "sshd(pam_unix)[{b}]", "authentication failure; uid=0 euid=0 rhost={ip}"),
    "session": ("combo", "su(pam_unix)[{b}]", "session opened for user root by (uid={a})"),
    "ftp": ("combo", "ftpd[{b}]", "connection from {ip}"),
    "su": ("combo", "su(pam_unix)[{b}]", "session closed for user news"),
    "system": ("combo", "kernel", "memory {a}k available"),
    "service": ("combo", "", "syslogd {a} restart"),
    "cbs": ("CBS", "", "Loaded servicing stack {a} at 0x{h}"),
    "csi": ("CSI", "", "component store call 0x{h} HRESULT = 0x{h}"),
    "trusted_installer": ("CBS", "", "TrustedInstaller service pass {a}"),
    "sqm": ("CBS", "", "SQM: upload {a} reports"),
    "transaction": ("CSI", "", "transaction {a} committed 0x{h}"),
    "quorum": ("QuorumPeer", "", "LEADING election round {a}"),
    "connection": ("NIOServerCxn", "", "accepted socket /{ip}:{a}"),
    "worker": ("RecvWorker", "", "interrupting worker {a}"),
    "notification": ("FastLeaderElection", "", "notification sid {a} zxid 0x{h}"),
    "zookeeper_session": ("SessionTracker", "", "expiring session 0x{h} timeout {a}ms"),
}
_STEP_CHAIN = ("onStandStepChanged {steps}", "setTodayTotalDetailSteps={steps}", "calculateCaloriesWithCache totalCalories={calories}", "calculateAltitudeWithCache totalAltitude=240")


#: Component, template and weight where nothing was learned.  Most templates that are drawn from.
FALLBACK_PATTERN = ("Component", "sample log <*>", 10.0)
MOST_PATTERNS = 50


def _draw(seed: int, what: str) -> Column:
    """A uniform number in [0, 1) that depends on seed, row and purpose."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "id"), F.lit(1 << 40)) / float(1 << 40)


def pick(seed: int, weights: dict[str, float]) -> Column:
    """A kind drawn by cumulative weight."""
    r, total = _draw(seed, "kind"), 0.0
    kinds = list(weights)
    out = F.lit(kinds[-1])
    steps = []
    for kind in kinds[:-1]:
        total += weights[kind]
        steps.append((total, kind))
    for bound, kind in reversed(steps):
        out = F.when(r < bound, kind).otherwise(out)
    return out


def fill_template(template: Column, seed: int) -> Column:
    """Each ``<*>`` replaced in turn by a number whose range the template's words choose."""
    low = F.lower(template)
    parts = F.split(template, r"<\*>", -1)
    lowest, width = (
        F.when(low.rlike("step|count"), a).when(F.contains(low, F.lit("calorie")), b).when(F.contains(low, F.lit("altitude")), c).otherwise(d)
        for a, b, c, d in ((3_000, 100_000, 240, 1), (1_001, 400_001, 1, 9_999))
    )
    filled = F.transform(
        parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat((lowest + F.pmod(F.xxhash64(F.lit(seed), "id", i), width)).cast("string"), p))
    )
    return F.array_join(filled, "")


def _time(kind: str, seconds: Column) -> Column:
    ts = F.timestamp_seconds(seconds)
    pattern = {"healthcare": "yyyyMMdd-HH:mm:ss:SSS", "linux": "MMM dd HH:mm:ss", "windows": "yyyy-MM-dd HH:mm:ss", "zookeeper": "yyyy-MM-dd HH:mm:ss,SSS"}
    return F.date_format(ts, pattern[kind])


def generate(spark: SparkSession, server_type: str, n: int, seed: int = 0, start: int = 1_700_000_000, partitions: int | None = None) -> DataFrame:
    """id, place, kind, line: ``n`` draws; a step chain is four lines, at places 0 to 3."""
    return log_lines(spark.range(0, n, 1, partitions) if partitions else spark.range(n), server_type, seed, start)


def generate_learned(spark: SparkSession, patterns: DataFrame | None, server_type: str, n: int, seed: int = 0, start: int = 1_700_000_000) -> DataFrame:
    """id, line: ``n`` lines of learned templates, each drawn as often as its share of ``n`` says, its gaps filled with numbers.

    ``patterns`` has template, n and optionally component, as the learner writes them (the most frequent ones of a server, MOST_PATTERNS at most);
    without any, or where it is None, the lines are those of one fallback template.
    """
    found = [] if patterns is None else patterns.select("template", F.col("n").cast("double").alias("n"), (F.col("component") if "component" in patterns.columns else F.lit("Component")).alias("component"))
    found = found if patterns is None else found.orderBy(F.desc("n"), "template").limit(MOST_PATTERNS).collect()
    listed = [(r["component"], r["template"], r["n"]) for r in found] or [FALLBACK_PATTERN]
    total = sum(weight for *_, weight in listed)
    chosen = pick(seed, {str(i): weight / total for i, (*_, weight) in enumerate(listed)}).cast("int")
    parts = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(t).alias("template")) for c, t, _ in listed])
    rows = spark.range(n).withColumn("p", F.get(parts, chosen))
    user = (30_000_000 + F.floor(_draw(seed, "user") * 10_000_000)).cast("string")
    line = format_line(F.lit(server_type), _time(server_type, F.lit(start) + F.col("id")), F.col("p.component"), user, F.lit(""), fill_template(F.col("p.template"), seed))
    return rows.select("id", line.alias("line"))


def log_file_name(server_type: Column, instance: Column, log_file: Column | None = None) -> Column:
    """``<base>_<instance>.log``; the base is the configured name without ``_server.log``, or the type where it does not end so."""
    low = F.lower(server_type)
    base = low if log_file is None else F.when(F.contains(log_file, F.lit("_server.log")), F.replace(log_file, F.lit("_server.log"), F.lit(""))).otherwise(low)
    return F.concat(base, F.lit("_"), instance.cast("string"), F.lit(".log"))


def log_lines(rows: DataFrame, server_type: str, seed: int = 0, start: int = 1_700_000_000) -> DataFrame:
    """id, place, kind, line of rows with ``id``, in batch or as a stream."""
    rows = rows.withColumn("kind", pick(seed, MIXTURES[server_type]))
    number = {
        "a": (1 + F.floor(_draw(seed, "a") * 9_999)).cast("string"),
        "b": (10_000 + F.floor(_draw(seed, "b") * 20_000)).cast("string"),
        "h": F.lower(F.hex(F.floor(_draw(seed, "h") * (1 << 36)).cast("long"))),
        "ip": F.concat_ws(".", *[F.floor(_draw(seed, f"ip{i}") * 254 + 1).cast("string") for i in range(4)]),
        "steps": (3_000 + F.pmod(F.col("id") * 2, F.lit(1_001))).cast("string"),
        "calories": (100_000 + F.pmod(F.col("id") * 34, F.lit(400_001))).cast("string"),
        "toggle": F.when(F.col("id") % 2 == 0, "ON").otherwise("OFF"),
    }

    def filled(text: str) -> Column:
        out = F.lit(text)
        for key, value in number.items():
            if "{" + key + "}" in text:
                out = F.replace(out, F.lit("{" + key + "}"), value)
        return out

    chain = F.array(*[F.struct(F.lit("Step_LSC").alias("component"), F.lit("").alias("process"), filled(m).alias("message")) for m in _STEP_CHAIN])
    parts = chain
    for kind in MIXTURES[server_type]:
        if kind == "step_chain":
            continue
        words = WORDING.get(f"{server_type}_{kind}", WORDING[kind])
        one = F.array(F.struct(*[filled(w).alias(name) for w, name in zip(words, ("component", "process", "message"))]))
        parts = F.when(F.col("kind") == kind, one).otherwise(parts)
    user = (30_000_000 + F.floor(_draw(seed, "user") * 10_000_000)).cast("string")
    rows = rows.select("id", "kind", user.alias("user_id"), F.posexplode(parts).alias("place", "p"))
    time = _time(server_type, F.lit(start) + F.col("id"))
    line = format_line(F.lit(server_type), time, F.col("p.component"), F.col("user_id"), F.col("p.process"), F.col("p.message"))
    return rows.select("id", "place", "kind", line.alias("line"))


def header(sid: str) -> str:
    """The first line of a log file."""
    return f"# SID: {sid}"
