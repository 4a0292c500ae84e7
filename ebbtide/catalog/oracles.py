"""DuckDB twins of the catalogued queries, written independently of the Spark code."""

from __future__ import annotations

from ebbtide.functions.risk import TIER_ADVICE, TIP_ADVICE

YES_NO = ["Partner", "Dependents", "PhoneService", "PaperlessBilling"]
RAW = (
    "customerID, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines, "
    "InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, "
    "StreamingMovies, Contract, PaperlessBilling, PaymentMethod, MonthlyCharges, TotalCharges, Churn"
)
CATEGORICAL_LEVELS = {
    "MultipleLines": ["No", "No phone service", "Yes"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "OnlineSecurity": ["No", "No internet service", "Yes"],
    "OnlineBackup": ["No", "No internet service", "Yes"],
    "DeviceProtection": ["No", "No internet service", "Yes"],
    "TechSupport": ["No", "No internet service", "Yes"],
    "StreamingTV": ["No", "No internet service", "Yes"],
    "StreamingMovies": ["No", "No internet service", "Yes"],
    "Contract": ["Month-to-month", "One year", "Two year"],
    "PaymentMethod": [
        "Bank transfer (automatic)",
        "Credit card (automatic)",
        "Electronic check",
        "Mailed check",
    ],
    "TenureGroup": ["Champion", "Established", "Growing", "Loyal", "New", "nan"],
    "SpendCategory": ["Budget", "Enterprise", "Premium", "Standard"],
    "MonthlyChargeBucket": ["Q1", "Q2", "Q3", "Q4", "Q5"],
    "InternetServiceCategory": ["High-Speed", "None", "Standard"],
    "RetentionRiskBucket": ["Critical", "High", "Low", "Minimal", "Moderate"],
}
NUMERICS = [
    "tenure",
    "MonthlyCharges",
    "TotalCharges",
    "AvgMonthlySpend",
    "CustomerLifetimeEstimate",
    "SupportUsageScore",
    "StreamingUsageScore",
]
PASSTHROUGH = [
    "gender",
    "SeniorCitizen",
    "Partner",
    "Dependents",
    "PhoneService",
    "PaperlessBilling",
    "HighValueCustomer",
    "ContractLength",
    "FamilyCustomer",
    "RetentionRiskScore",
    "HighCharge_MTM",
    "NewNoSupport",
    "FiberNoSecurity",
    "ChargeXTenure",
]


def u(field: str, key: str = "c_custkey::varchar") -> str:
    return f"(('0x'||substr(md5({key}||':{field}'),1,8))::bigint / 4294967296.0::double)"


def r(value: str, places: int = 2) -> str:
    scale = f"{10 ** places}::double"
    return f"(round_even(({value})*{scale},0)/{scale})"


def attributes(key: str = "c_custkey::varchar") -> str:
    """Select list of the drawn columns; needs internet and phone."""

    def add_on(name: str, field: str, share: float) -> str:
        return (
            f"CASE WHEN internet='No' THEN 'No internet service' "
            f"WHEN {u(field, key)} < {share} THEN 'Yes' ELSE 'No' END AS {name}"
        )

    pay = u("pay", key)
    return ", ".join(
        [
            f"CASE WHEN {u('gender', key)} < 0.5 THEN 'Male' ELSE 'Female' END AS gender",
            f"CASE WHEN {u('senior', key)} < 0.84 THEN 0 ELSE 1 END::int AS SeniorCitizen",
            f"CASE WHEN {u('partner', key)} < 0.48 THEN 'Yes' ELSE 'No' END AS Partner",
            f"CASE WHEN {u('dependents', key)} < 0.30 THEN 'Yes' ELSE 'No' END AS Dependents",
            "phone AS PhoneService",
            f"CASE WHEN phone='No' THEN 'No phone service' WHEN {u('lines', key)} < 0.42 THEN 'Yes' "
            "ELSE 'No' END AS MultipleLines",
            "internet AS InternetService",
            add_on("OnlineSecurity", "security", 0.30),
            add_on("OnlineBackup", "backup", 0.34),
            add_on("DeviceProtection", "device", 0.34),
            add_on("TechSupport", "techsupport", 0.30),
            add_on("StreamingTV", "tv", 0.38),
            add_on("StreamingMovies", "movies", 0.39),
            f"CASE WHEN {u('paperless', key)} < 0.59 THEN 'Yes' ELSE 'No' END AS PaperlessBilling",
            f"CASE WHEN {pay} < 0.34 THEN 'Electronic check' WHEN {pay} < 0.57 THEN 'Mailed check' "
            f"WHEN {pay} < 0.79 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END "
            "AS PaymentMethod",
        ]
    )


def draws(key: str = "c_custkey::varchar") -> str:
    internet = u("internet", key)
    return (
        f"CASE WHEN {u('phone', key)} < 0.90 THEN 'Yes' ELSE 'No' END AS phone, "
        f"CASE WHEN {internet} < 0.34 THEN 'DSL' WHEN {internet} < 0.78 THEN 'Fiber optic' "
        "ELSE 'No' END AS internet"
    )


# The terms of the rule, in the order in which they are added.
TERMS = {
    "Contract": "(CASE WHEN Contract='Month-to-month' THEN 0.35::double ELSE 0 END "
    "+ CASE WHEN Contract='One year' THEN 0.08::double ELSE 0 END)",
    "tenure": "(-greatest(0::double, least(tenure/72.0::double, 0.30::double)))",
    "InternetService": "(CASE WHEN InternetService='Fiber optic' THEN 0.15::double ELSE 0 END)",
    "OnlineSecurity": "(CASE WHEN OnlineSecurity='No' THEN 0.08::double ELSE 0 END)",
    "TechSupport": "(CASE WHEN TechSupport='No' THEN 0.07::double ELSE 0 END)",
    "MonthlyCharges": "(greatest(0::double, least((MonthlyCharges-70.0::double)/100.0::double, 0.12::double)))",
    "SeniorCitizen": "(CASE WHEN SeniorCitizen=1 THEN 0.05::double ELSE 0 END)",
    "Partner": "(CASE WHEN Partner='Yes' THEN -0.05::double ELSE 0 END)",
    "Dependents": "(CASE WHEN Dependents='Yes' THEN -0.04::double ELSE 0 END)",
}
SCORE = r("+".join(TERMS.values()), 12)


def sigmoid(score: str) -> str:
    return f"(1.0::double/(1.0::double+exp(-4.0::double*({score}))))"


CUST_ID = "'CUST-'||lpad({k}::varchar, greatest(6, length({k}::varchar))::int, '0') AS customerID"

SUBS = f"""
seen AS (
  SELECT o_custkey, min(o_orderdate::date) AS first_order FROM orders
  WHERE o_orderdate::date < (DATE '1995-07-01' + to_months(((o_custkey*37)%67)::int))::date
  GROUP BY o_custkey),
base AS (
  SELECT c.*, s.first_order, {draws()},
    (DATE '1995-07-01' + to_months(((c_custkey*37)%67)::int))::date AS as_of
  FROM customer c LEFT JOIN seen s ON s.o_custkey = c.c_custkey),
attrs AS (
  SELECT c_custkey, first_order, {CUST_ID.format(k='c_custkey')}, {attributes()},
    coalesce((year(as_of)-year(first_order))*12+month(as_of)-month(first_order), 0)::int AS tenure,
    CASE c_mktsegment WHEN 'FURNITURE' THEN 'One year' WHEN 'MACHINERY' THEN 'Two year'
      ELSE 'Month-to-month' END AS Contract,
    {r('18.0::double + 102.0::double*(c_acctbal+1000.0::double)/11000.0::double')} AS MonthlyCharges
  FROM base),
raw AS (
  SELECT *, CASE WHEN first_order IS NULL THEN ' ' ELSE
      {r(f"MonthlyCharges*greatest(tenure,1)*(0.95::double+0.1::double*{u('total')})")}::varchar END
      AS TotalCharges,
    CASE WHEN {u('churn')} < {sigmoid(SCORE)} THEN 'Yes' ELSE 'No' END AS Churn
  FROM attrs)"""

FAULTY = f"""{SUBS},
bad AS (
  SELECT * REPLACE (
    CASE WHEN {u('no_label')} >= 0.01 THEN Churn END AS Churn,
    CASE WHEN {u('bad_tenure')} < 0.01 THEN -1 ELSE tenure END::int AS tenure,
    CASE WHEN {u('padded')} < 0.05 THEN ' '||chr(9)||Contract||'  ' ELSE Contract END AS Contract,
    CASE WHEN {u('bad_total')} < 0.01 THEN 'abc' WHEN {u('bad_total')} < 0.02 THEN '1.0d'
      WHEN {u('bad_total')} < 0.03 THEN 'NaN' WHEN {u('bad_total')} < 0.04 THEN '1,200'
      WHEN {u('bad_total')} < 0.05 THEN ' 1e2 ' ELSE TotalCharges END AS TotalCharges)
  FROM raw),
faulty AS (
  SELECT {RAW} FROM bad CROSS JOIN unnest([1,2,3]) AS copies(i)
  WHERE i = 1 OR {u('copied')} < 0.03)"""

NUMBER = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
STRIPPED = f"""parsed AS (
  SELECT * REPLACE (trim(Contract, ' '||chr(9)) AS Contract,
    CASE WHEN regexp_full_match(trim(TotalCharges), {NUMBER}) THEN try_cast(trim(TotalCharges) AS double)
      END AS TotalCharges)
  FROM faulty),
clean AS (
  SELECT * REPLACE (coalesce(TotalCharges, tenure*MonthlyCharges) AS TotalCharges) FROM parsed
  WHERE Churn IS NOT NULL)"""


def yes_no(name: str) -> str:
    return f"CASE {name} WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END::int AS {name}"


CONVERTED = ", ".join(
    ["CASE WHEN lower(gender)='male' THEN 1 ELSE 0 END::int AS gender"]
    + [yes_no(name) for name in [*YES_NO, "Churn"]]
)

TYPED = f"""{SUBS},
filled AS (
  SELECT {RAW} FROM (SELECT * REPLACE (
    coalesce(try_cast(trim(TotalCharges) AS double), tenure*MonthlyCharges) AS TotalCharges) FROM raw)),
typed AS (SELECT * REPLACE ({CONVERTED}) FROM filled)"""


def bins(column: str, edges: list, labels: list[str], outside: str = "'nan'") -> str:
    cases = " ".join(
        f"WHEN {column} > {low} AND {f'{column} <= {high}' if high is not None else 'true'} THEN '{label}'"
        for low, high, label in zip(edges, edges[1:], labels)
    )
    return f"CASE {cases} ELSE {outside} END"


def count_of(names: list[str], word: str) -> str:
    return "(" + "+".join(f"({name}='{word}')::int" for name in names) + ")::int"


AVG_SPEND = r("CASE WHEN tenure > 0 THEN TotalCharges/tenure ELSE MonthlyCharges END")
LENGTH = "CASE Contract WHEN 'One year' THEN 12 WHEN 'Two year' THEN 24 ELSE 1 END::int"
RISK_SCORE = (
    "((Contract='Month-to-month')::int+(TechSupport='No')::int+(OnlineSecurity='No')::int"
    "+(tenure<12)::int+(MonthlyCharges>80)::int+(PaperlessBilling=1)::int)::int"
)
SUPPORT = count_of(["TechSupport", "OnlineSecurity", "DeviceProtection"], "Yes")
STREAMING = count_of(["StreamingTV", "StreamingMovies"], "Yes")
FEATURE_SQL = {
    "TenureGroup": bins(
        "tenure", [0, 12, 24, 48, 60, None], ["New", "Growing", "Established", "Loyal", "Champion"]
    ),
    "SpendCategory": bins(
        "MonthlyCharges", [0, 35, 65, 85, None], ["Budget", "Standard", "Premium", "Enterprise"]
    ),
    "MonthlyChargeBucket": bins(
        "MonthlyCharges", [0, 25, 55, 80, 100, None], ["Q1", "Q2", "Q3", "Q4", "Q5"]
    ),
    "AvgMonthlySpend": AVG_SPEND,
    "HighValueCustomer": "(MonthlyCharges >= 70)::int",
    "ContractLength": LENGTH,
    "CustomerLifetimeEstimate": r(
        f"{AVG_SPEND}*({LENGTH})*(CASE WHEN ({LENGTH}) > 1 THEN 1.5::double ELSE 1.0::double END)"
    ),
    "SupportUsageScore": SUPPORT,
    "StreamingUsageScore": STREAMING,
    "InternetServiceCategory": "CASE InternetService WHEN 'Fiber optic' THEN 'High-Speed' "
    "WHEN 'DSL' THEN 'Standard' ELSE 'None' END",
    "FamilyCustomer": "(Partner=1 AND Dependents=1)::int",
    "RetentionRiskScore": RISK_SCORE,
    "RetentionRiskBucket": bins(
        RISK_SCORE, [-1, 1, 2, 3, 4, 6], ["Minimal", "Low", "Moderate", "High", "Critical"]
    ),
    "HighCharge_MTM": "(MonthlyCharges > 80 AND Contract='Month-to-month')::int",
    "NewNoSupport": f"(tenure < 12 AND {SUPPORT} = 0)::int",
    "FiberNoSecurity": "(InternetService='Fiber optic' AND OnlineSecurity='No')::int",
    "ChargeXTenure": r("MonthlyCharges*tenure"),
}
FEATURES = f"""{TYPED},
features AS (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in FEATURE_SQL.items())} FROM typed)"""


def feature(*names: str, also: str = "") -> str:
    picked = ", ".join(f"{FEATURE_SQL[name]} AS {name}" for name in names)
    return f"WITH {TYPED} SELECT customerID, {also}{picked} FROM typed"


P = sigmoid(SCORE)
SCORED = f"""{SUBS},
scored AS (SELECT *, (Churn='Yes')::int AS label, {P} AS p FROM raw)"""


def by_tier(values: list[str]) -> str:
    low, medium, high, very_high = (f"'{value}'" for value in values)
    return (
        f"CASE WHEN p < 0.25 THEN {low} WHEN p < 0.5 THEN {medium} WHEN p < 0.75 THEN {high} "
        f"ELSE {very_high} END"
    )


TIER = by_tier(["Low Risk", "Medium Risk", "High Risk", "Very High Risk"])
COLOUR = by_tier(["#00C48C", "#FFB300", "#FF6B35", "#E53E3E"])


def advice(tiers: dict[str, str], tips: dict[str, str], separator: str) -> str:
    upgrade, support, security = (f"'{text}'" for text in tips.values())
    return (
        f"concat_ws({separator}, {by_tier(list(tiers.values()))}, "
        f"CASE WHEN contains(Contract,'Month') THEN {upgrade} END, "
        f"CASE WHEN TechSupport='No' THEN {support} END, "
        f"CASE WHEN OnlineSecurity='No' THEN {security} END)"
    )


ADVICE = advice(TIER_ADVICE, TIP_ADVICE, "'  '||chr(10)")
CODES = advice({code: code for code in TIER_ADVICE}, {code: code for code in TIP_ADVICE}, "','")
PCT = r("p*100")
BATCH = f"""{SCORED},
batch AS (SELECT {RAW}, {PCT} AS ChurnProbability, (p >= 0.5)::int AS ChurnPrediction,
  CASE WHEN p >= 0.5 THEN 'Churn' ELSE 'No Churn' END AS ChurnPrediction_Label,
  {TIER} AS RiskLabel, {COLOUR} AS RiskColor, {ADVICE} AS Recommendation FROM scored)"""

MONTHS = "greatest(0, 24-tenure)"
AT_RISK = r(f"MonthlyCharges*{MONTHS}*p")
COST = r("MonthlyCharges*0.15::double*12")
SAVINGS = r(f"{AT_RISK}-{COST}")

LABEL_NAME = "CASE Churn WHEN 'Yes' THEN 'Churn' ELSE 'No Churn' END"

# Confusion counts and what follows from them, for one row with tp, fp, fn, tn.
ACCURACY = "(tp+tn)::double/(tp+fp+fn+tn)"
PRECISION = "CASE WHEN tp+fp = 0 THEN 0 ELSE tp::double/(tp+fp) END"
RECALL = "CASE WHEN tp+fn = 0 THEN 0 ELSE tp::double/(tp+fn) END"
F1 = "CASE WHEN 2*tp+fp+fn = 0 THEN 0 ELSE 2*tp::double/(2*tp+fp+fn) END"


def confusion(condition: str) -> str:
    return (
        f"count(*) FILTER (label=1 AND {condition}) AS tp, count(*) FILTER (label=0 AND {condition}) AS fp, "
        f"count(*) FILTER (label=1 AND NOT ({condition})) AS fn, "
        f"count(*) FILTER (label=0 AND NOT ({condition})) AS tn"
    )


def auc_sql(table: str, keys: str = "") -> str:
    """Rank-sum AUC per group from average ranks."""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}
      (sum(CASE WHEN label=1 THEN avg_rank END) - sum(label)::double*(sum(label)+1)/2)
        / (sum(label)::double*sum(1-label)) AS auc
    FROM (SELECT *, low_rank + (ties-1)/2.0::double AS avg_rank FROM (
      SELECT *, rank() OVER ({part} ORDER BY p) AS low_rank,
        count(*) OVER (PARTITION BY {lead}p) AS ties FROM {table}))
    {group}"""


CURVE = f"""{SCORED},
tied AS (SELECT p, sum(label)::double AS pos, sum(1-label)::double AS neg FROM scored GROUP BY p),
curve AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER () AS allpos, sum(neg) OVER () AS allneg
  FROM tied WINDOW w AS (ORDER BY p DESC))"""

MEASURES = f"""{SCORED},
counts AS (SELECT {confusion('p >= 0.5')} FROM scored),
area AS ({auc_sql('scored')}),
measures AS (SELECT {r(ACCURACY, 4)} AS accuracy, {r(PRECISION, 4)} AS precision,
  {r(RECALL, 4)} AS recall, {r(F1, 4)} AS f1_score, {r('auc', 4)} AS roc_auc,
  (tp+fp+fn+tn)::double AS n_samples, {r('(tp+fn)::double/(tp+fp+fn+tn)', 4)} AS churn_rate,
  0.5::double AS threshold FROM counts, area)"""

NUMERIC_TERMS = ("tenure", "MonthlyCharges", "SeniorCitizen")
ATTRIBUTION = f"""{SUBS},
terms AS (SELECT customerID, tenure, MonthlyCharges, SeniorCitizen,
  {', '.join(f'{sql} AS t_{name}' for name, sql in TERMS.items())} FROM raw),
means AS (SELECT {', '.join(f'avg(t_{name}) AS m_{name}' for name in TERMS)} FROM terms),
attribution AS ({' UNION ALL '.join(
    f"SELECT customerID, '{name}' AS feature, "
    f"{name if name in NUMERIC_TERMS else 't_' + name}::double AS feature_value, "
    f"{r(f't_{name} - m_{name}', 9)} AS phi FROM terms, means"
    for name in TERMS)})"""

ENCODED_NAMES = [f"{name}_{level}" for name, levels in CATEGORICAL_LEVELS.items() for level in levels]


def moments() -> str:
    return ", ".join(f"avg({n}) AS mu_{n}, stddev_pop({n}) AS sd_{n}" for n in NUMERICS)


def scaled(name: str) -> str:
    return f"({name} - mu_{name}) / CASE WHEN sd_{name} = 0 THEN 1 ELSE sd_{name} END"


def encoded_list(places: int | None = 6) -> list[tuple[str, str]]:
    columns = [(name, f"{name}::double") for name in PASSTHROUGH]
    columns += [(name, scaled(name)) for name in NUMERICS]
    columns += [
        (f"{name}_{level}", f"({name} = '{level}')::int::double")
        for name, levels in CATEGORICAL_LEVELS.items()
        for level in levels
    ]
    return [(name, r(sql, places) if places else sql) for name, sql in columns]


def correlations(table: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, {r(f'corr({x}::double, {y}::double)', 6)} AS corr FROM {table}"
        for x in names
        for y in names
    )


MTM = "Contract='Month-to-month'"
SEGMENTS = {
    "month_to_month_vs_two_year": (MTM, "Contract='Two year'"),
    "tenure_24_plus": ("tenure >= 24", "NOT (tenure >= 24)"),
    "charges_above_80": ("MonthlyCharges > 80", "NOT (MonthlyCharges > 80)"),
    "no_tech_support": ("TechSupport='No'", "TechSupport='Yes'"),
    "online_security": ("OnlineSecurity='Yes'", "OnlineSecurity='No'"),
    "family": ("Partner='Yes' AND Dependents='Yes'", "NOT (Partner='Yes' AND Dependents='Yes')"),
}
TARGETS = {
    "month_to_month": MTM,
    "fiber_without_support_or_security": "InternetService='Fiber optic' AND (TechSupport='No' OR OnlineSecurity='No')",
    "tenure_12_to_24": "tenure BETWEEN 12 AND 24",
    "high_charge_month_to_month": f"{MTM} AND MonthlyCharges > 80",
    "tenure_below_6": "tenure < 6",
}

SWEEP = [18.0 + i * 102.0 / 19 for i in range(20)]

REJECT_RULES = {
    "negative_tenure": "tenure < 0",
    "non_positive_charge": "MonthlyCharges <= 0",
    "missing_tenure": "tenure IS NULL",
    "missing_MonthlyCharges": "MonthlyCharges IS NULL",
    "missing_Contract": "Contract IS NULL",
    "missing_InternetService": "InternetService IS NULL",
    **{
        f"unknown_{name}": f"{name} IS NOT NULL AND trim({name}) NOT IN ('Yes','No','1','0')"
        for name in [*YES_NO, "Churn"]
    },
}
RAW_TYPES = {
    name: "int" if name in ("SeniorCitizen", "tenure") else "double" if name == "MonthlyCharges" else "string"
    for name in RAW.split(", ")
}

GEN_KEY = "('42:'||c_custkey::varchar)"


def between(field: str, low: float, high: float) -> str:
    return f"({low}::double + {high - low}::double*{u(field, GEN_KEY)})"


ADD_ONS = {
    "OnlineSecurity": (3, 7),
    "OnlineBackup": (3, 7),
    "DeviceProtection": (3, 7),
    "TechSupport": (3, 7),
    "StreamingTV": (5, 8),
    "StreamingMovies": (5, 8),
}
GENERATED_CHARGE = (
    between("base", 18, 30)
    + f"+ CASE WHEN PhoneService='Yes' THEN {between('phone_add', 8, 12)} ELSE 0 END"
    + f"+ CASE InternetService WHEN 'Fiber optic' THEN {between('internet_add', 35, 50)} "
    + f"WHEN 'DSL' THEN {between('internet_add', 18, 30)} ELSE 0 END"
    + "".join(
        f"+ CASE WHEN {name}='Yes' THEN {between(name + '_add', *limits)} ELSE 0 END"
        for name, limits in ADD_ONS.items()
    )
)
NOISE = (
    f"0.08::double*sqrt(-2.0::double*ln(1.0::double-{u('noise1', GEN_KEY)}))"
    f"*cos(2.0::double*pi()*{u('noise2', GEN_KEY)})"
)
GENERATED = f"""WITH base AS (SELECT c_custkey, {draws(GEN_KEY)} FROM customer),
attrs AS (SELECT c_custkey, {CUST_ID.format(k='c_custkey')}, {attributes(GEN_KEY)},
    floor({u('tenure', GEN_KEY)}*73)::int AS tenure,
    CASE WHEN {u('contract', GEN_KEY)} < 0.55 THEN 'Month-to-month'
      WHEN {u('contract', GEN_KEY)} < 0.76 THEN 'One year' ELSE 'Two year' END AS Contract
  FROM base),
charged AS (SELECT *, {r(GENERATED_CHARGE)} AS MonthlyCharges,
    row_number() OVER (ORDER BY {u('blank', GEN_KEY)}) AS blank_rank FROM attrs),
raw AS (SELECT *, CASE WHEN blank_rank <= 11 THEN ' ' ELSE
      {r(f"MonthlyCharges*greatest(tenure,1)*{between('total', 0.95, 1.05)}")}::varchar END AS TotalCharges,
    CASE WHEN {u('churn', GEN_KEY)} < {sigmoid(SCORE + '+' + NOISE)} THEN 'Yes' ELSE 'No' END AS Churn
  FROM charged)
SELECT {RAW} FROM raw"""

RULE_INPUTS = list(TERMS)
PERMUTATION = f"""WITH {SCORED},
rows AS (SELECT customerID, label, {', '.join(RULE_INPUTS)}, rep.i AS repeat,
    md5(customerID||':shift42:'||rep.i) AS place FROM scored CROSS JOIN unnest(range(10)) AS rep(i)),
shifted AS (SELECT *, {', '.join(
    f"coalesce(lead({n}) OVER w, first_value({n}) OVER w) AS nb_{n}" for n in RULE_INPUTS)}
  FROM rows WINDOW w AS (PARTITION BY repeat ORDER BY place, customerID)),
mixed AS (SELECT label, repeat, f.name AS feature, {', '.join(
    f"CASE WHEN f.name='{n}' THEN nb_{n} ELSE {n} END AS {n}" for n in RULE_INPUTS)}
  FROM shifted CROSS JOIN unnest([{', '.join(f"'{n}'" for n in RULE_INPUTS)}]) AS f(name)),
rescored AS (SELECT label, repeat, feature, {P} AS p FROM mixed),
areas AS ({auc_sql('rescored', 'feature, repeat')}),
area AS ({auc_sql('scored')}),
drops AS (SELECT feature, area.auc - areas.auc AS d FROM areas, area)
SELECT feature, {r('avg(d)', 6)} AS importance_mean, {r('stddev_pop(d)', 6)} AS importance_std
FROM drops GROUP BY feature ORDER BY importance_mean DESC, feature LIMIT 20"""


def top_variance() -> str:
    """Correlations of the 15 columns with the largest variance; long form, then corr per pair."""
    names = [*PASSTHROUGH, *NUMERICS, "Churn"]
    # The label comes in place of Churn on the Spark side.
    alias = {"Churn": "label"}
    long = " UNION ALL ".join(
        f"SELECT customerID, '{alias.get(n, n)}' AS name, {n}::double AS value FROM features" for n in names
    )
    return f"""WITH {FEATURES}, long AS ({long}),
    kept AS (SELECT name FROM long GROUP BY name ORDER BY var_samp(value) DESC LIMIT 15)
    SELECT a.name AS x, b.name AS y, {r('corr(a.value, b.value)', 6)} AS corr
    FROM long a JOIN long b ON a.customerID = b.customerID
    WHERE a.name IN (SELECT name FROM kept) AND b.name IN (SELECT name FROM kept)
    GROUP BY a.name, b.name"""


def history(limit: int = 50) -> str:
    return f"""WITH {SCORED},
    ranked AS (SELECT event_id, user_id,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::int AS position FROM events)
    SELECT user_id, position, event_id, tenure, MonthlyCharges, Contract, InternetService,
      {r('p*100', 1)} AS churn_pct, {TIER} AS risk_label
    FROM ranked LEFT JOIN scored ON c_custkey = user_id WHERE position <= {limit}"""


def report() -> str:
    """Long classification report from the four counts."""
    rate = {
        ("0", "precision"): "CASE WHEN tn+fn = 0 THEN 0 ELSE tn::double/(tn+fn) END",
        ("0", "recall"): "CASE WHEN tn+fp = 0 THEN 0 ELSE tn::double/(tn+fp) END",
        ("0", "f1_score"): "CASE WHEN 2*tn+fn+fp = 0 THEN 0 ELSE 2*tn::double/(2*tn+fn+fp) END",
        ("1", "precision"): PRECISION,
        ("1", "recall"): RECALL,
        ("1", "f1_score"): F1,
    }
    cells = dict(rate)
    for m in ("precision", "recall", "f1_score"):
        cells["macro avg", m] = f"(({rate['0', m]})+({rate['1', m]}))/2"
        cells["weighted avg", m] = (
            f"(({rate['0', m]})*(tn+fp)+({rate['1', m]})*(tp+fn))/(tp+fp+fn+tn)"
        )
    cells["0", "support"] = "tn+fp"
    cells["1", "support"] = "tp+fn"
    for row in ("accuracy", "macro avg", "weighted avg"):
        cells[row, "support"] = "tp+fp+fn+tn"
    cells["accuracy", "accuracy"] = ACCURACY
    selects = " UNION ALL ".join(
        f"SELECT '{row}' AS row, '{metric}' AS metric, {r(f'({sql})::double', 4)} AS value FROM counts"
        for (row, metric), sql in cells.items()
    )
    return f"WITH {SCORED}, counts AS (SELECT {confusion('p >= 0.5')} FROM scored) {selects}"


def cv() -> str:
    metrics = {"accuracy": ACCURACY, "precision": PRECISION, "recall": RECALL, "f1_score": F1, "roc_auc": "auc"}
    long = " UNION ALL ".join(
        f"SELECT '{name}' AS metric, {r(sql, 4)} AS value FROM measured" for name, sql in metrics.items()
    )
    return f"""WITH {SCORED}, folded AS (SELECT *, {FOLD} AS fold FROM scored),
    counts AS (SELECT fold, {confusion('p >= 0.5')} FROM folded GROUP BY fold),
    areas AS ({auc_sql('folded', 'fold')}),
    measured AS (SELECT * FROM counts JOIN areas USING (fold)), long AS ({long})
    SELECT metric, {r('avg(value)', 4)} AS mean, {r('stddev_pop(value)', 4)} AS std FROM long GROUP BY metric"""


def profile(table: str, names: list[str], kinds: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, '{kinds[n]}' AS data_type, count(*) AS row_count, "
        f"count(*) FILTER ({n} IS NULL) AS null_count FROM {table}"
        for n in names
    )


FOLD = f"((row_number() OVER (PARTITION BY label ORDER BY {u('fold42', 'customerID')}, customerID) - 1) % 5)::int"
SPLIT_LIMIT = "round(count(*) OVER (PARTITION BY label) * 0.2)"
LABELLED = f"{SUBS}, labelled AS (SELECT customerID, (Churn='Yes')::int AS label FROM raw)"

EDGES = "quantile_cont(feature_value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])"

ORACLES: dict[str, str] = {
    "subscriber_view": f"WITH {SUBS} SELECT {RAW} FROM raw",
    "csv_round_trip": f"WITH {SUBS} SELECT {RAW} FROM raw",
    "csv_null_tokens": f"WITH {SUBS}, drawn AS (SELECT *, {u('token', 'customerID')} AS d FROM raw) SELECT customerID, "
    "CASE WHEN d >= 0.1 THEN Contract END AS Contract, "
    "CASE WHEN d < 0.1 OR d >= 0.2 THEN PaymentMethod END AS PaymentMethod, "
    "CASE WHEN d < 0.2 OR d >= 0.3 THEN gender END AS gender, "
    "CASE WHEN d < 0.3 OR d >= 0.4 THEN TotalCharges END AS TotalCharges FROM drawn",
    "upload_scores": f"WITH {BATCH} SELECT customerID, ChurnProbability, ChurnPrediction, ChurnPrediction_Label, "
    "RiskLabel, Recommendation FROM batch",
    "importance_round_trip": f"WITH {ATTRIBUTION} SELECT feature, {r('avg(abs(phi))', 6)} AS importance "
    "FROM attribution GROUP BY feature ORDER BY importance DESC, feature LIMIT 5",
    "missing_columns": f"WITH {FAULTY} SELECT 'missing_columns' AS rule, 1::bigint AS violations "
    "UNION ALL SELECT 'negative_tenure', count(*) FILTER (tenure < 0) FROM faulty "
    "UNION ALL SELECT 'non_positive_charge', count(*) FILTER (MonthlyCharges <= 0) FROM faulty",
    "nan_charges": f"WITH {TYPED}, bare AS (SELECT * REPLACE (CASE WHEN {u('nan_charge', 'customerID')} >= 0.05 "
    "THEN MonthlyCharges END AS MonthlyCharges) FROM typed) SELECT customerID, MonthlyCharges, "
    f"{FEATURE_SQL['SpendCategory']} AS SpendCategory, coalesce((MonthlyCharges >= 70)::int, 0) AS HighValueCustomer, "
    f"{RISK_SCORE.replace('(MonthlyCharges>80)::int', 'coalesce((MonthlyCharges>80)::int, 0)')} AS RetentionRiskScore, "
    "coalesce((MonthlyCharges > 80 AND Contract='Month-to-month')::int, 0) AS HighCharge_MTM FROM bare",
    "unknown_levels": f"WITH {TYPED} SELECT customerID, "
    f"({u('no_payment', 'customerID')} < 0.1)::int::double AS PaymentMethod_Unknown FROM typed",
    "absent_columns": f"WITH {FEATURES} SELECT customerID, 0.0::double AS gender, 0.0::double AS PaperlessBilling, "
    "Partner::double AS Partner, (RetentionRiskScore - (PaperlessBilling=1)::int)::double AS RetentionRiskScore "
    "FROM features",
    "processed_round_trip": f"WITH {FEATURES}, m AS (SELECT {moments()} FROM features), "
    f"wide AS (SELECT {', '.join(f'sum({sql}) AS {chr(34)}{name}{chr(34)}' for name, sql in encoded_list(None))} "
    "FROM features, m) "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS feature, {r(chr(34) + name + chr(34), 4)} + 0.0 AS total FROM wide"
        for name, _ in encoded_list(None)
    ),
    "batch_export": f"WITH {BATCH} SELECT customerID, ChurnProbability, ChurnPrediction, "
    "ChurnPrediction_Label, RiskLabel, 25::int AS n_columns FROM batch",
    "metrics_round_trip": "SELECT 'rule' AS model, metric, value FROM "
    f"(WITH {MEASURES} SELECT accuracy, precision, recall, f1_score, roc_auc FROM measures) "
    "UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1_score, roc_auc))",
    "generated_customers": GENERATED,
    "clean_subscribers": f"WITH {FAULTY}, {STRIPPED} SELECT * FROM clean",
    "dedupe_subscribers": f"WITH {FAULTY}, {STRIPPED} SELECT DISTINCT * FROM clean",
    "converted_types": f"WITH {FAULTY}, {STRIPPED} SELECT * REPLACE ({CONVERTED}) FROM (SELECT DISTINCT * FROM clean)",
    "validation_summary": f"WITH {FAULTY} SELECT 'missing_columns' AS rule, 0::bigint AS violations "
    "UNION ALL SELECT 'negative_tenure', count(*) FILTER (tenure < 0) FROM faulty "
    "UNION ALL SELECT 'non_positive_charge', count(*) FILTER (MonthlyCharges <= 0) FROM faulty",
    "reject_rows": f"WITH {FAULTY}, checked AS (SELECT customerID, tenure, concat_ws(',', "
    + ", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in REJECT_RULES.items())
    + ") AS reasons FROM faulty) SELECT * FROM checked WHERE reasons <> ''",
    "null_profile": f"WITH {FAULTY}, {STRIPPED}, all_columns AS ({profile('parsed', list(RAW_TYPES), RAW_TYPES)}) "
    "SELECT column_name, null_count FROM all_columns WHERE null_count > 0",
    "table_profile": f"WITH {FAULTY} {profile('faulty', list(RAW_TYPES), RAW_TYPES)}",
    "tenure_group": feature("TenureGroup", also="tenure, "),
    "spend_category": feature("SpendCategory", also="MonthlyCharges, "),
    "charge_bucket": feature("MonthlyChargeBucket", also="MonthlyCharges, "),
    "avg_monthly_spend": feature("AvgMonthlySpend"),
    "high_value": feature("HighValueCustomer", also="MonthlyCharges, "),
    "contract_length": feature("ContractLength", also="Contract, "),
    "lifetime_estimate": feature("CustomerLifetimeEstimate"),
    "support_score": feature("SupportUsageScore"),
    "streaming_score": feature("StreamingUsageScore"),
    "internet_category": feature("InternetServiceCategory", also="InternetService, "),
    "family_flag": feature("FamilyCustomer"),
    "retention_risk": feature("RetentionRiskScore", "RetentionRiskBucket"),
    "interactions": feature("HighCharge_MTM", "NewNoSupport", "FiberNoSecurity", "ChargeXTenure"),
    "all_features": f"WITH {FEATURES} SELECT * FROM features",
    "onehot_long": f"WITH {FEATURES} "
    + " UNION ALL ".join(
        f"SELECT customerID, '{name}_'||{name} AS feature FROM features" for name in CATEGORICAL_LEVELS
    ),
    "scaled_numerics": f"WITH {FEATURES}, m AS (SELECT {moments()} FROM features) SELECT customerID, "
    + ", ".join(f"{r(scaled(n), 6)} AS {n}" for n in NUMERICS)
    + " FROM features, m",
    "aligned_matrix": f"WITH {FEATURES}, m AS (SELECT {moments()} FROM features) SELECT customerID, "
    + ", ".join(f'{sql} AS "{name}"' for name, sql in encoded_list() if name != "gender")
    + ', 0.0::double AS "Contract_Lifetime" FROM features, m',
    "stratified_split": f"WITH {LABELLED} SELECT customerID, label, "
    f"row_number() OVER (PARTITION BY label ORDER BY {u('split42', 'customerID')}, customerID) "
    f"<= {SPLIT_LIMIT} AS is_test FROM labelled",
    "split_counts": f"WITH {LABELLED} SELECT {u('split42', 'customerID')} < 0.2 AS is_test, count(*) AS n, "
    f"{r('avg(label)', 6)} AS churn_rate FROM labelled GROUP BY 1",
    "fold_counts": f"WITH {LABELLED}, folded AS (SELECT {FOLD} AS fold, label FROM labelled) "
    "SELECT fold, label, count(*) AS n FROM folded GROUP BY 1, 2",
    "row_weights": f"WITH {LABELLED} SELECT label, 1.0::double AS weight_none, "
    f"{r('(SELECT count(*) FROM labelled)::double / (2*count(*))', 9)} AS weight_balanced, "
    "1.0::double AS weight_pos_1, (CASE label WHEN 1 THEN 2 ELSE 1 END)::double AS weight_pos_2, "
    "(CASE label WHEN 1 THEN 3 ELSE 1 END)::double AS weight_pos_3, count(*) AS n FROM labelled GROUP BY label",
    "class_weights": f"WITH {LABELLED} SELECT label, count(*) AS n, "
    f"{r('(SELECT count(*) FROM labelled)::double / (2*count(*))', 9)} AS weight FROM labelled GROUP BY label",
    "rule_score": f"WITH {SCORED} SELECT customerID, {r(SCORE, 9)} AS score, {r('p', 9)} AS probability FROM scored",
    "predictions": f"WITH {SCORED} SELECT customerID, (p >= 0.6)::int AS prediction FROM scored",
    "batch_scores": f"WITH {BATCH} SELECT * FROM batch",
    "batch_rate": f"WITH {BATCH} SELECT count(*) AS rows, {r('avg(ChurnPrediction)*100')} AS churn_rate_pct FROM batch",
    "risk_labels": f"WITH {SCORED} SELECT customerID, {TIER} AS risk_label, {COLOUR} AS risk_color FROM scored",
    "action_codes": f"WITH {SCORED} SELECT customerID, {CODES} AS action_codes FROM scored",
    "business_impact": f"WITH {SCORED} SELECT customerID, {AT_RISK} AS revenue_at_risk, {COST} AS retention_cost, "
    f"{SAVINGS} AS estimated_savings, "
    f"CASE WHEN {COST} > 0 THEN {r(f'{SAVINGS}/{COST}*100', 1)} ELSE 0 END AS roi_pct, "
    f"{MONTHS}::int AS avg_remaining_tenure_months FROM scored",
    "single_impact": f"WITH {SCORED} SELECT customerID, {r('p', 4)} AS probability, {PCT} AS probability_pct, "
    f"{TIER} AS risk_label, {COLOUR} AS risk_color, (p >= 0.5)::int AS churn_binary, {ADVICE} AS recommendation, "
    f"{r(f'MonthlyCharges*{MONTHS}')} AS retention_impact_usd, "
    f"{r(r(f'MonthlyCharges*{MONTHS}') + '*0.8::double')} AS estimated_savings_usd, "
    f"{MONTHS}::int AS avg_tenure_remaining_months FROM scored",
    "whatif_curve": f"WITH {SUBS}, swept AS (SELECT raw.* REPLACE (c.charge AS MonthlyCharges), c.point FROM raw "
    f"CROSS JOIN (VALUES {', '.join(f'({i}, {c!r}::double)' for i, c in enumerate(SWEEP))}) AS c(point, charge)) "
    f"SELECT point::int AS point, {r('min(MonthlyCharges)', 6)} AS charge, "
    f"{r(f'avg({P})*100', 4)} AS mean_probability_pct FROM swept GROUP BY point",
    "history_last50": history(),
    "stream_scores": f"WITH {SCORED} SELECT event_id, user_id, {PCT} AS ChurnProbability, "
    f"(p >= 0.5)::int AS ChurnPrediction, {TIER} AS RiskLabel FROM events LEFT JOIN scored ON c_custkey = user_id",
    "metrics_at_half": f"WITH {MEASURES} SELECT 'all' AS split, metric, value FROM (UNPIVOT measures ON "
    "COLUMNS(*) INTO NAME metric VALUE value)",
    "roc_auc": f"WITH {SCORED}, area AS ({auc_sql('scored')}) SELECT {r('auc', 9)} AS roc_auc FROM area",
    "confusion": f"WITH {SCORED}, counts AS (SELECT {confusion('p >= 0.5')} FROM scored) "
    "SELECT 0::int AS label, 0::int AS prediction, tn AS n FROM counts UNION ALL "
    "SELECT 0, 1, fp FROM counts UNION ALL SELECT 1, 0, fn FROM counts UNION ALL SELECT 1, 1, tp FROM counts",
    "class_report": report(),
    "roc_points": f"WITH {CURVE} SELECT {r('p', 9)} AS threshold, {r('fp/allneg', 9)} AS fpr, "
    f"{r('tp/allpos', 9)} AS tpr FROM curve UNION ALL SELECT 'infinity'::double, 0.0::double, 0.0::double",
    "pr_points": f"WITH {CURVE} SELECT {r('p', 9)} AS threshold, {r('tp/(tp+fp)', 9)} AS precision, "
    f"{r('tp/allpos', 9)} AS recall FROM curve UNION ALL SELECT 'infinity'::double, 1.0::double, 0.0::double",
    "curve_summary": f"WITH {CURVE}, steps AS (SELECT *, lag(tp, 1, 0.0::double) OVER w AS tp0, "
    "lag(fp, 1, 0.0::double) OVER w AS fp0, lag(tp/(tp+fp), 1, 1.0::double) OVER w AS prec0 "
    "FROM curve WINDOW w AS (ORDER BY p DESC)) "
    f"SELECT {r('sum((fp-fp0)/allneg*(tp+tp0)/2/allpos)', 9)} AS roc_auc, "
    f"{r('sum((tp-tp0)/allpos*(tp/(tp+fp)+prec0)/2)', 9)} AS pr_auc, "
    f"{r('max(allpos)/(max(allpos)+max(allneg))', 9)} AS base_rate FROM steps",
    "threshold_table": f"WITH {SCORED}, counts AS (SELECT t, {confusion('p >= t')} FROM scored "
    f"CROSS JOIN unnest([{', '.join(f'{t / 100}::double' for t in range(10, 91, 5))}]) AS grid(t) GROUP BY t) "
    f"SELECT {r('t', 9)} AS threshold, {r(ACCURACY, 9)} AS accuracy, {r(PRECISION, 9)} AS precision, "
    f"{r(RECALL, 9)} AS recall, {r(F1, 9)} AS f1 FROM counts",
    "rule_cv_summary": cv(),
    "linear_attribution": f"WITH {ATTRIBUTION} SELECT * FROM attribution",
    "attribution_summary": f"WITH {ATTRIBUTION} SELECT feature, count(*) AS n, {r('avg(abs(phi))', 6)} AS mean_abs_phi, "
    f"{r('quantile_cont(phi, 0.05)', 6)} AS p05, {r('quantile_cont(phi, 0.5)', 6)} AS median, "
    f"{r('quantile_cont(phi, 0.95)', 6)} AS p95 FROM attribution GROUP BY feature "
    "ORDER BY mean_abs_phi DESC, feature LIMIT 20",
    "waterfall_topk": f"WITH {ATTRIBUTION}, start AS (SELECT {'+'.join(f'm_{n}' for n in TERMS)} AS b FROM means), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY abs(phi) DESC, feature) AS k "
    "FROM attribution) "
    f"SELECT customerID, k::int AS position, feature, {r('phi', 6)} AS phi FROM ranked WHERE k <= 5 UNION ALL "
    f"SELECT customerID, 6::int, 'rest', {r('sum(phi)', 6)} FROM ranked WHERE k > 5 GROUP BY customerID UNION ALL "
    f"SELECT customerID, 0::int, 'base value', {r('b', 6)} FROM terms, start",
    "dependence_bins": f"WITH {ATTRIBUTION}, top AS (SELECT feature FROM attribution GROUP BY feature "
    f"ORDER BY {r('avg(abs(phi))', 6)} DESC, feature LIMIT 3), "
    "chosen AS (SELECT * FROM attribution WHERE feature IN (SELECT feature FROM top)), "
    f"edges AS (SELECT feature, {EDGES} AS e FROM chosen GROUP BY feature) "
    "SELECT feature, bin, count(*) AS n, "
    f"{r('avg(feature_value)', 6)} AS mean_value, {r('avg(phi)', 6)} AS mean_phi FROM "
    "(SELECT c.*, len(list_filter(e, lambda x: x < feature_value))::int AS bin FROM chosen c JOIN edges USING (feature)) "
    "GROUP BY feature, bin",
    "rule_permutation_importance": PERMUTATION,
    "explained_sample": f"WITH {LABELLED} SELECT * FROM labelled ORDER BY md5(customerID||':sample42') LIMIT 300",
    "dataset_kpis": f"WITH {FAULTY} SELECT count(*) AS customers, "
    f"{r('(count(*) FILTER (Churn = $$Yes$$))::double/count(*)', 6)} AS churn_rate, 21::int AS n_columns, "
    f"({' + '.join(f'count(*) FILTER ({n} IS NULL)' for n in RAW_TYPES)})::bigint AS missing_cells FROM faulty",
    "churn_share": f"WITH {SUBS} SELECT {LABEL_NAME} AS label_name, count(*) AS n, "
    f"{r('100.0::double*count(*)/sum(count(*)) OVER ()', 4)} AS pct FROM raw GROUP BY 1",
    "internet_share": f"WITH {SUBS} SELECT InternetService, count(*) AS n, "
    f"{r('100.0::double*count(*)/sum(count(*)) OVER ()', 4)} AS pct FROM raw GROUP BY 1",
    "tenure_hist": f"WITH {SUBS}, span AS (SELECT min(tenure)::double AS lo, max(tenure)::double AS hi FROM raw) "
    f"SELECT {LABEL_NAME} AS label_name, least(floor((tenure-lo)/((hi-lo)/30.0::double)), 29)::int AS bin, "
    "count(*) AS n FROM raw, span GROUP BY 1, 2",
    "charges_box": f"WITH {SUBS} SELECT {LABEL_NAME} AS label_name, count(*) AS n, min(MonthlyCharges) AS minimum, "
    f"{r('quantile_cont(MonthlyCharges, 0.25)', 6)} AS q1, {r('quantile_cont(MonthlyCharges, 0.5)', 6)} AS median, "
    f"{r('quantile_cont(MonthlyCharges, 0.75)', 6)} AS q3, max(MonthlyCharges) AS maximum, "
    f"{r('avg(MonthlyCharges)', 6)} AS mean FROM raw GROUP BY 1",
    "contract_churn": f"WITH {SUBS} SELECT Contract, {LABEL_NAME} AS label_name, count(*) AS n FROM raw GROUP BY 1, 2",
    "risk_distribution": f"WITH {BATCH} SELECT t.position::int AS position, t.label AS RiskLabel, "
    "count(b.customerID) AS n FROM (VALUES (0,'Low Risk'),(1,'Medium Risk'),(2,'High Risk'),(3,'Very High Risk')) "
    "AS t(position, label) LEFT JOIN batch b ON b.RiskLabel = t.label GROUP BY 1, 2",
    "probability_hist": f"WITH {BATCH} SELECT RiskLabel, least(floor(ChurnProbability/2.5::double), 39)::int AS bin, "
    "count(*) AS n FROM batch GROUP BY 1, 2",
    "correlation": f"WITH {SUBS}, num AS (SELECT SeniorCitizen, tenure, MonthlyCharges, "
    "try_cast(trim(TotalCharges) AS double) AS TotalCharges, (Churn='Yes')::int AS Churn_binary FROM raw) "
    + correlations("num", ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "Churn_binary"]),
    "correlation_top_variance": top_variance(),
    "churn_by_contract": f"WITH {SUBS} SELECT Contract, count(*) AS customers, "
    f"{r('avg((Churn = $$Yes$$)::int)*100', 4)} AS churn_rate_pct FROM raw GROUP BY 1",
    "churn_by_tenure": f"WITH {SUBS}, banded AS (SELECT Churn, "
    + bins("tenure", [0, 12, 24, 48, 60, 73], ["0-12 mo", "13-24 mo", "25-48 mo", "49-60 mo", "60+ mo"], "NULL")
    + f" AS tenure_band FROM raw) SELECT tenure_band, {r('avg((Churn = $$Yes$$)::int)*100', 4)} AS churn_rate_pct "
    "FROM banded WHERE tenure_band IS NOT NULL GROUP BY 1",
    "segment_lift": f"WITH {SUBS}, seg AS ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS segment, count(*) FILTER ({a}) AS n_in, count(*) FILTER ({b}) AS n_out, "
        f"avg((Churn='Yes')::int) FILTER ({a}) AS i, avg((Churn='Yes')::int) FILTER ({b}) AS o FROM raw"
        for name, (a, b) in SEGMENTS.items()
    )
    + f") SELECT segment, n_in, n_out, {r('i', 6)} AS rate_in, {r('o', 6)} AS rate_out, "
    f"{r('i/nullif(o,0)', 6)} AS ratio FROM seg",
    "target_segments": f"WITH {SUBS} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS segment, count(*) FILTER ({sql}) AS customers, "
        f"{r(f'coalesce(sum(MonthlyCharges) FILTER ({sql}), 0)')} AS monthly_charges, "
        f"{r(f'coalesce(avg((Churn = $$Yes$$)::int) FILTER ({sql}), 0)', 6)} AS churn_rate FROM raw"
        for name, sql in TARGETS.items()
    ),
    "raw_preview": f"WITH {SUBS} SELECT {RAW} FROM raw ORDER BY customerID LIMIT 100",
    "batch_preview": f"WITH {BATCH} SELECT customerID, ChurnProbability, ChurnPrediction_Label, RiskLabel, "
    "Recommendation FROM batch ORDER BY customerID LIMIT 20",
}
