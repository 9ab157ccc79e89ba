"""Row rules compiled into one aggregate: every check of a table is a conditional count in the same pass."""
from __future__ import annotations

import re
from functools import lru_cache
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.model import Rule, any_of, col, finding, kind_of, rate_status
from plumbline.plans.scans import Part, scan

WARN_RATE, FAIL_RATE = 0.001, 0.01


def run_rules(df: DataFrame, rules: Sequence[Rule], warn: float = WARN_RATE, fail: float = FAIL_RATE) -> DataFrame:
    """Findings for every rule in one scan; rules whose columns are absent are left out.

    A hard rule fails on any violation; a soft rule warns and fails by rate.
    """
    here = [r for r in rules if set(r.columns) <= set(df.columns)]
    if not here:
        from plumbline.model import FINDINGS_SCHEMA

        return df.sparkSession.createDataFrame([], FINDINGS_SCHEMA)
    return scan(df, rules_part(here, warn, fail))


def rules_part(rules: Sequence[Rule], warn: float = WARN_RATE, fail: float = FAIL_RATE) -> Part:
    """The rules as a share of a scan; their columns are there."""
    wants = {"n": F.count(F.lit(1))}
    for i, r in enumerate(rules):
        base = r.applicable if r.applicable is not None else F.lit(True)
        wants |= {f"v{i}": F.count_if(r.condition), f"b{i}": F.count_if(base)}

    def tell(at):
        for i, r in enumerate(rules):
            v = at(f"v{i}")
            rate = F.coalesce(F.try_divide(v.cast("double"), at(f"b{i}")), F.lit(0.0))
            status = F.when(v == 0, "pass").otherwise("fail") if r.severity == "hard" else rate_status(rate, warn, fail)
            yield finding(r.layer, r.rule, r.columns, status, r.severity, v, F.round(rate, 6), r.detail)

    return Part(wants, tell)


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that break a rule, with the list of rules they break."""
    here = [r for r in rules if set(r.columns) <= set(df.columns)]
    broken = F.array_compact(F.array(*[F.when(r.condition, F.lit(r.rule)) for r in here]))
    return df.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


def user_rule(rule: str, requires: Sequence[str], condition: str, severity: str = "hard", layer: str = "custom") -> Rule:
    """A rule given as an SQL condition on the violating rows."""
    return Rule(rule, tuple(requires), F.expr(condition), layer, severity)


# ---- names -------------------------------------------------------------------------


WORD_OF_NAME = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z0-9]+")


def name_tokens(name: str) -> list[str]:
    """Words of a column name in lower case: by separators, case changes and runs of capitals (``LOSDays``: los, days)."""
    return [w.lower() for w in WORD_OF_NAME.findall(name)]


@lru_cache(maxsize=256)
def _vocabulary(words: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, words)) or "(?!)")


def has_keyword(name: str, words: Sequence[str]) -> bool:
    """Whether a word of the vocabulary stands anywhere in the name, separators aside."""
    return _vocabulary(tuple(words)).search("".join(name_tokens(name))) is not None


def as_date(c: str) -> Column:
    return col(c).cast("string").try_cast("date")


def text_of(c: str) -> Column:
    return F.lower(F.trim(col(c).cast("string")))


# ---- fixed values: temporal and flag rules ------------------------------------------

TEMPORAL_PAIRS = [
    ("admit_before_discharge", "hard",
     r"^(admit|admission|admit_date|admitdt|admission_date|admit_dt|encounter_start|start_date|from_date)$",
     r"^(discharge|discharge_date|dischargedt|disch_date|disch_dt|encounter_end|end_date|to_date|thru_date)$"),
    ("order_before_result", "hard",
     r"^(order_date|ordered_date|order_dt|lab_order_date|test_order_date)$",
     r"^(result_date|resulted_date|result_dt|lab_result_date|report_date)$"),
    ("claim_before_payment", "hard",
     r"^(claim_date|clm_date|service_date|dos|date_of_service|from_date|billed_date)$",
     r"^(payment_date|paid_date|remit_date|eob_date|adjudication_date)$"),
    ("birth_before_death", "hard",
     r"^(dob|date_of_birth|birth_date|birthdt|birth_dt|patient_dob)$",
     r"^(dod|date_of_death|death_date|deathdt|death_dt|patient_dod)$"),
    ("service_before_auth", "soft",
     r"^(auth_date|authorization_date|prior_auth_date|preauth_date)$",
     r"^(service_date|dos|date_of_service|procedure_date|surgery_date)$"),
]

FLAG_CONDITIONS = [
    ("readmit_30d_implies_90d", ("readmit_30d", "readmit_90d"), "readmit_30d = 1 AND readmit_90d = 0", "hard"),
    ("readmit_7d_implies_30d", ("readmit_7d", "readmit_30d"), "readmit_7d = 1 AND readmit_30d = 0", "hard"),
    ("readmit_7d_implies_90d", ("readmit_7d", "readmit_90d"), "readmit_7d = 1 AND readmit_90d = 0", "hard"),
    ("inpatient_outpatient_exclusive", ("inpatient", "outpatient"), "inpatient = 1 AND outpatient = 1", "hard"),
    ("emergency_elective_exclusive", ("emergency_admit", "elective_admit"), "emergency_admit = 1 AND elective_admit = 1", "hard"),
    ("deceased_live_discharge", ("deceased", "discharge_disposition"),
     "deceased = 1 AND lower(cast(discharge_disposition as string)) NOT IN ('20','expired','dead','deceased','40','41','42')", "soft"),
]


def temporal_rules(columns: Sequence[str], pairs: Sequence[tuple[str, str, str, str]] = ()) -> list[Rule]:
    """Order-of-events rules found by name, or given as ``(rule, severity, earlier, later)``."""
    found = list(pairs)
    if not found:
        for rule, sev, early, late in TEMPORAL_PAIRS:
            e = [c for c in columns if re.match(early, c, re.IGNORECASE)]
            l = [c for c in columns if re.match(late, c, re.IGNORECASE)]
            if e and l:
                found.append((rule, sev, e[0], l[0]))
    rules = []
    for rule, sev, e, l in found:
        both = as_date(e).isNotNull() & as_date(l).isNotNull()
        rules.append(Rule(rule, (e, l), both & (as_date(l) < as_date(e)), "temporal", sev, f"{l} before {e}", both))
    return rules


def flag_rules() -> list[Rule]:
    return [user_rule(r, cols, cond, sev, "flags") for r, cols, cond, sev in FLAG_CONDITIONS]


# ---- fixed values: cross-column vocabulary ------------------------------------------

DATE_ORDER_WORDS = [
    (("admit", "admission"), ("discharge",)),
    (("start", "begin", "from", "onset", "open"), ("end", "finish", "stop", "close", "thru")),
    (("created", "create", "opened"), ("updated", "update", "modified", "closed", "edited")),
    (("checkin", "arrival", "arrive"), ("checkout", "departure", "depart")),
    (("order", "ordered", "purchase"), ("ship", "shipped", "delivery", "delivered", "fulfilled")),
    (("hire", "hired", "joined"), ("termination", "terminated", "left", "resigned")),
    (("birth", "dob", "born"), ("death", "died", "deceased", "expired")),
    (("effective", "issued", "issue"), ("expiry", "expire", "expiration", "expires")),
]
MAGNITUDE_WORDS = [
    (("allowed",), ("billed", "charged", "charge", "gross")),
    (("paid", "payment", "reimbursed", "reimbursement"), ("allowed",)),
    (("paid", "payment", "reimbursed", "reimbursement"), ("billed", "charged", "charge", "gross")),
]
DATE_NAME_WORDS = ("date", "time", "admit", "discharge", "dob", "birth", "checkin", "checkout", "arrival", "departure")
LOW_WORDS = ("min", "minimum", "low", "lower", "floor")
HIGH_WORDS = ("max", "maximum", "high", "higher", "ceiling", "cap", "upper")
PREGNANCY_WORDS = ("pregnant", "pregnancy", "gestation", "gestational", "gravida", "prenatal", "antenatal", "edd")
ADULT_WORDS = ("retire", "retirement", "pension", "401k", "isadult", "hasmortgage", "haslicense", "issenior", "medicare")
STATUS_WORDS = ("flag", "status", "result", "interpretation", "abnormality")
READMIT_WORDS = ("readmit", "readmission", "rehospital", "rehosp")
MALE_VALUES = ("m", "male", "man", "boy")
YES_VALUES = ("true", "t", "yes", "y", "1", "positive", "pos", "pregnant")
ABNORMAL_TEXT = r"crit|abnormal|out.?of.?range|panic|high|low|elevated|alert|positive|reactive"
ADULT_MARITAL_TEXT = r"marri|divorc|widow|separat|civil union|domestic partner"


def _shared_stem(a: str, b: str, drop: Sequence[str]) -> bool:
    ta = {t for t in name_tokens(a) if t not in drop}
    tb = {t for t in name_tokens(b) if t not in drop}
    return not ta or bool(ta & tb)


def cross_column_rules(df: DataFrame, extra_dates: Sequence[tuple[str, str]] = (), extra_ranges: Sequence[tuple[str, str]] = (), extra_magnitudes: Sequence[tuple[str, str]] = ()) -> list[Rule]:
    """Impossible combinations found by column name, plus pairs named by the caller."""
    cols = df.columns
    numbers = [c for c in cols if kind_of(df.schema[c].dataType) == "number"]
    datey = [c for c in cols if kind_of(df.schema[c].dataType) == "date" or has_keyword(c, DATE_NAME_WORDS) or re.search(r"_(at|on)$", c)]
    add = lambda rule, c, cond, detail="": Rule(rule, tuple(c), F.coalesce(cond, F.lit(False)), "cross_column", "hard", detail)
    rules: list[Rule] = []
    pairs = list(extra_dates)
    for early, late in DATE_ORDER_WORDS:
        pairs += [(e, l) for e in datey if has_keyword(e, early) for l in datey if has_keyword(l, late) and e != l]
    rules += [add("date_order", p, as_date(p[1]) < as_date(p[0])) for p in dict.fromkeys(pairs)]
    ranges = list(extra_ranges) + [
        (lo, hi) for lo in numbers if has_keyword(lo, LOW_WORDS) for hi in numbers
        if has_keyword(hi, HIGH_WORDS) and lo != hi and _shared_stem(lo, hi, LOW_WORDS + HIGH_WORDS)
    ]
    rules += [add("numeric_range", p, col(p[1]) < col(p[0])) for p in dict.fromkeys(ranges)]
    words = [w for less, more in MAGNITUDE_WORDS for w in less + more]
    mags = list(extra_magnitudes)
    for less, more in MAGNITUDE_WORDS:
        mags += [(a, b) for a in numbers if has_keyword(a, less) for b in numbers if has_keyword(b, more) and a != b and _shared_stem(a, b, words)]
    rules += [add("magnitude_order", p, col(p[0]) > col(p[1])) for p in dict.fromkeys(mags)]
    sex = next((c for c in cols if {"sex", "gender"} & set(name_tokens(c))), None)
    age = next((c for c in numbers if "age" in name_tokens(c)), None)
    marital = next((c for c in cols if has_keyword(c, ("marital",))), None)
    if sex:
        rules += [add("sex_pregnancy", (sex, p), text_of(sex).isin(*MALE_VALUES) & text_of(p).isin(*YES_VALUES)) for p in cols if has_keyword(p, PREGNANCY_WORDS) and p != sex]
    if age and marital:
        rules.append(add("infant_marital", (age, marital), (col(age) < 1) & text_of(marital).rlike(ADULT_MARITAL_TEXT)))
    if age:
        rules += [add("minor_adult_status", (age, f), (col(age) < 18) & text_of(f).isin(*YES_VALUES)) for f in cols if has_keyword(f, ADULT_WORDS) and f != age]
    for s in (c for c in cols if has_keyword(c, STATUS_WORDS)):
        stem = {t for t in name_tokens(s) if t not in STATUS_WORDS}
        for m in numbers:
            if stem and m != s and stem & {t for t in name_tokens(m) if t not in STATUS_WORDS}:
                rules.append(add("status_without_measure", (m, s), col(m).isNull() & text_of(s).rlike(ABNORMAL_TEXT)))
    los = next((c for c in numbers if "los" in name_tokens(c) or {"length", "stay"} <= set(name_tokens(c))), None)
    admit = next((c for c in cols if has_keyword(c, ("admit", "admission"))), None)
    leave = next((c for c in cols if has_keyword(c, ("discharge",))), None)
    if los and admit and leave and admit != leave:
        rules.append(add("los_date_mismatch", (los, admit, leave), F.abs(col(los).cast("int") - F.datediff(as_date(leave), as_date(admit))) >= 2))
    back = [c for c in cols if has_keyword(c, READMIT_WORDS)]
    r30 = next((c for c in back if any("30" in t or t == "thirty" for t in name_tokens(c))), None)
    r90 = next((c for c in back if any("90" in t or t == "ninety" for t in name_tokens(c))), None)
    if r30 and r90 and r30 != r90:
        rules.append(add("readmit_flag_inconsistency", (r30, r90), text_of(r30).isin("1", "true", "yes", "y", "t") & text_of(r90).isin("0", "false", "no", "n", "f")))
    return rules


# ---- fixed values: code families and forbidden pairs --------------------------------

DRG_FAMILIES = [
    ("heart_failure", (291, 292, 293), ("I50", "R570", "I42", "I43", "I110", "I130", "I132")),
    ("acute_myocardial_infarction", (280, 281, 282, 283, 284, 285), ("I21", "I22")),
    ("stroke", (61, 62, 63, 64, 65, 66, 67, 68, 69, 70), ("I60", "I61", "I62", "I63", "I64", "G45", "G46")),
    ("pneumonia", (193, 194, 195), ("J12", "J13", "J14", "J15", "J16", "J17", "J18", "J90", "J94")),
    ("respiratory_failure", (189, 190, 191, 192, 927, 928), ("J96", "J80", "J81", "J82", "J44", "J45", "J68", "J70")),
    ("sepsis", (870, 871, 872), ("A40", "A41", "R652")),
    ("joint_replacement", (469, 470), ("M16", "M17", "M87", "S72", "S82", "M05", "M06", "M08", "Z96")),
    ("copd", (696, 697, 698), ("J44", "J47")),
]
FORBIDDEN_PAIRS = [("58260", "58720"), ("58260", "58150"), ("77066", "77065"), ("49000", "44005"), ("93451", "93318")]


def drg_rules(drg: str, icd: str) -> list[Rule]:
    """Diagnosis outside the families its group code allows."""
    code, dx = F.trim(col(drg).cast("string")), F.upper(F.trim(col(icd).cast("string")))
    out = []
    for family, drgs, prefixes in DRG_FAMILIES:
        in_family = code.isin(*[str(d) for d in drgs])
        bad = in_family & dx.isNotNull() & ~any_of([dx.startswith(p) for p in prefixes])
        out.append(Rule(f"drg_icd_{family}", (drg, icd), F.coalesce(bad, F.lit(False)), "drg_icd", "hard", "", F.coalesce(in_family, F.lit(False))))
    return out


def forbidden_pairs(spark) -> DataFrame:
    return spark.createDataFrame(FORBIDDEN_PAIRS, "code_a string, code_b string")


# ---- fixed values: vital signs and definitional bounds ------------------------------

VITALS = [
    ("systolic", ("sys", "sbp", "bpsys"), ("systol",), 40, 370),
    ("diastolic", ("dia", "dbp", "bpdia"), ("diastol",), 15, 250),
    ("heart_rate", ("hr", "bpm", "pulse"), ("heart", "pulse"), 20, 300),
    ("respiratory_rate", ("rr", "resp"), ("respir", "breath"), 3, 80),
    ("spo2", ("spo2", "sao2", "o2sat", "o2"), ("oxygen", "saturation"), 50, 100),
    ("temperature", ("temp", "tmp"), ("temperatur", "fahrenheit", "celsius"), None, None),
]
TEMPERATURE_BOUNDS = {"C": (12, 45), "F": (53, 113)}


def match_vital(name: str):
    toks = name_tokens(name)
    for v in VITALS:
        if any(t in v[1] for t in toks) or any(t.startswith(s) for t in toks for s in v[2]):
            return v
    return None


def vital_rules(df: DataFrame, columns: dict[str, str] | None = None) -> list[Rule]:
    """Plausible-limit rules; temperature units come from the name or, failing that, the median."""
    numbers = [c for c in df.columns if kind_of(df.schema[c].dataType) == "number"]
    by_name = {v[0]: v for v in VITALS}
    found = {c: by_name[k] for c, k in columns.items()} if columns else {c: match_vital(c) for c in numbers}
    rules, first = [], {}
    for c, v in found.items():
        if v is None:
            continue
        kind, _, _, low, high = v
        if kind == "temperature":
            toks = name_tokens(c)
            if "f" in toks or any(t.startswith("fahren") for t in toks):
                unit = "F"
            elif "c" in toks or any(t.startswith("celsi") for t in toks):
                unit = "C"
            else:
                from plumbline.functions.stats import quantile_map

                med = quantile_map(df, [c], [0.5]).get((c, 0.5))
                unit = "F" if med is not None and med >= 50 else "C"
            low, high = TEMPERATURE_BOUNDS[unit]
        first.setdefault(kind, c)
        rules.append(Rule(f"{kind}_limits", (c,), F.coalesce((col(c) < low) | (col(c) > high), F.lit(False)), "vitals", "hard", f"{low}..{high}", col(c).isNotNull()))
    if "systolic" in first and "diastolic" in first:
        s, d = first["systolic"], first["diastolic"]
        rules.append(Rule("diastolic_above_systolic", (s, d), F.coalesce(col(d) > col(s), F.lit(False)), "vitals", "hard", "", col(s).isNotNull() & col(d).isNotNull()))
    return rules


PERCENT_RATE_WORDS = {
    "success", "completion", "complete", "pass", "fail", "failure", "conversion", "response", "retention", "adoption",
    "utilization", "utilisation", "occupancy", "win", "click", "clickthrough", "ctr", "attendance", "approval", "denial",
    "accuracy", "participation", "turnout", "engagement", "bounce",
}
UNBOUNDED_WORDS = {
    "growth", "change", "increase", "decrease", "delta", "return", "returns", "roi", "yoy", "mom", "wow", "qoq", "markup",
    "margin", "gain", "yield", "variance", "deviation", "profit", "multiplier", "leverage", "gross", "net",
}


def bounded_kind(name: str) -> str | None:
    toks = name_tokens(name)
    if not toks or match_vital(name) or UNBOUNDED_WORDS & set(toks):
        return None
    if "pct" in toks or any(t.startswith("percent") for t in toks):
        return "percentage"
    if "prob" in toks or any(t.startswith(("proportion", "probab")) for t in toks):
        return "proportion"
    if "rate" in toks and PERCENT_RATE_WORDS & set(toks):
        return "rate_like"
    return "ambiguous" if {"rate", "ratio"} & set(toks) else None


def bound_checks(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Values outside 0-1 or 0-100 where a column is bounded by definition.

    Which bound applies is decided from the value distribution, so one aggregate counts
    violations of both bounds and the choice is an expression over its result row.
    """
    part = bounds_part(df, columns)
    if not part.wants:
        from plumbline.model import FINDINGS_SCHEMA

        return df.sparkSession.createDataFrame([], FINDINGS_SCHEMA)
    return scan(df, part).where("status <> 'idle'")


def bounds_part(df: DataFrame, columns: dict[str, str] | None = None) -> Part:
    """The bound checks as a share of a scan; a column without a clear bound is idle."""
    numbers = [c for c in df.columns if kind_of(df.schema[c].dataType) == "number"]
    kinds = columns or {c: bounded_kind(c) for c in numbers}
    kinds = {c: k for c, k in kinds.items() if k}
    wants = {}
    for i, c in enumerate(kinds):
        x = col(c)
        wants |= {
            f"n{i}": F.count(x), f"u{i}": F.count_if(x.between(0, 1)), f"h{i}": F.count_if(x.between(0, 100)),
            f"lo{i}": F.count_if(x < 0), f"o{i}": F.count_if(x > 1), f"t{i}": F.count_if(x > 100),
        }

    def tell(at):
        for i, (c, kind) in enumerate(kinds.items()):
            n, u, h = at(f"n{i}"), at(f"u{i}"), at(f"h{i}")
            unit = (F.try_divide(u, n) >= 0.8) & (F.try_divide(h - u, n) <= 0.1)
            hundred = F.try_divide(h, n) >= 0.9
            high = {
                "percentage": F.when(unit, 1).otherwise(100),
                "proportion": F.when(unit, 1).when(hundred, 100),
                "rate_like": F.when(unit, 1).when(hundred, 100),
                "ambiguous": F.when(unit, 1),
            }[kind]
            count = F.when(high == 1, at(f"o{i}")).otherwise(at(f"t{i}")) + at(f"lo{i}")
            status = F.when(high.isNull(), "idle").when(count > 0, "fail").otherwise("pass")
            rate = F.coalesce(F.try_divide(count.cast("double"), n), F.lit(0.0))
            yield finding("bounds", f"{kind}_bounds", [c], status, "hard", count, F.round(rate, 6), F.concat(F.lit("0.."), high.cast("string")))

    return Part(wants, tell)
