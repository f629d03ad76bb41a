"""Personal data: high-recall generators propose spans, boosted trees score them, a calibrated threshold selects. DataFrame operations only.

The base kinds (email, ip, card, phone) are found by fixed patterns with format checks and always stay. Further generators propose spans
of other writings: credentials, local phone numbers, social security numbers, IBANs and spelt-out addresses. The trees are fitted once
per call on a small generated set of labelled candidates and applied as a CASE expression over the same features.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import free_prefix, let, scan

#: Base patterns, written so that Java's matcher neither recurses nor rescans a run of characters.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Words that announce a credential.
SECRET_CUES = "password|passwd|pwd|secret|token|api.?key|access.?key|credential|auth"
GENERATORS = {
    # North American writings, and national ones that begin with 0: 020 7946 0958, 01 23 45 67 89, 0151/2345678.
    "local_phone": r"(?<![0-9+(.-])(?:(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\(?0[0-9]{1,4}\)?(?:[ ./-][0-9]{2,8}){1,4}+)(?![0-9-])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}+:){2,7}+(?::?[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+)*+)?+(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}+:){1,6}+:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+)*+(?![0-9A-Za-z:])",
    "jwt": r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+(?![A-Za-z0-9_-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "spelt_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){1,4}+",
    # The value after a credential cue and an equals sign or colon, or any run of 10 characters that holds a digit.
    "secret": rf"(?:(?<=[=:])|(?<=[=:] )|(?<=[=:][\"'])|(?<=[=:] [\"']))(?<=(?i:{SECRET_CUES})[\"']? ?[=:] ?[\"']?)[^\s\"'<>,;=:][^\s\"'<>,;]{{2,}}(?<![.:!?)])"
    r"|(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{10,}+(?:={1,2}+(?![A-Za-z0-9_+/=-]))?+",
}
KINDS = [*BASE, *GENERATORS]
#: Words that announce a kind, searched in the CONTEXT code points before a span.
CONTEXT = 28
CUES = {
    "secret": SECRET_CUES,
    "phone": "phone|tel|call|fax|mobile|cell|contact|ring",
    "number": "ssn|social|iban|account|bank|security",
    "mail": "mail|contact|write|reach",
}
FEATURES = ["length", "digits", "uppers", "vowels", "joints", "letter_run", "hexes", "switches", "puncts", "assigned", "tight", "quoted", "cue_secret", "cue_phone", "cue_number", "cue_mail", *(f"is_{k}" for k in GENERATORS)]


#: A span with its place in code points, end exclusive, and the CONTEXT code points before it.
SPAN = "struct<start:int,end:int,kind:string,body:string,before:string>"


def _none() -> Column:
    return F.from_json(F.lit("[]"), f"array<{SPAN}>")


def _right(text: Column) -> Column:
    return F.substring(text, -CONTEXT, CONTEXT)


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """Array of SPAN of the leftmost non-overlapping matches. Matches and the gaps between them are walked once, with the end of the text so far."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))

    def step(acc: Column, pair: Column) -> tuple[Column, Column]:
        begin = acc["at"] + F.length(pair["gap"])
        before, body = _right(F.concat(acc["tail"], pair["gap"])), pair["body"]
        end = begin + F.length(body)
        out = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), body.alias("body"), before.alias("before"))
        return F.struct(end.alias("at"), _right(F.concat(before, body)).alias("tail")), out

    bodies, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(bodies.alias("body"), gaps.alias("gap")), lambda x: x["body"].isNotNull())
    return F.when(F.regexp_like(text, F.lit(pattern)), scan(pairs, start, step, SPAN)).otherwise(_none())


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, body: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.regexp_like(body, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return luhn(_digits(body))
    if kind == "phone":
        return F.length(_digits(body)).between(9, 15)
    return F.lit(True)


def _checked(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["body"]))


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start and then kind as listed."""
    parts = []
    for kind, pattern in BASE.items():
        found = _checked(_spans(text, kind, pattern), kind)
        parts.append(F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(_none()) if NEEDS[kind] else found)
    return _by_start(F.concat(*parts))


def _by_start(spans: Column) -> Column:
    place = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s.alias("s"))))
    return F.transform(keyed, lambda x: x["s"])


def candidate_features(span: Column) -> Column:
    """The FEATURES of one candidate, as a struct of doubles."""
    body, size = span["body"], F.length(span["body"])
    before = F.lower(span["before"])
    share = lambda pattern: (size - F.length(F.regexp_replace(body, pattern, ""))) / size
    values = {
        "length": size,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "vowels": share("[aeiou]"),
        "joints": share("[_./-]"),
        "letter_run": F.array_max(F.transform(F.split(body, "[^a-z]+"), lambda x: F.length(x))) / size,
        "hexes": share("[0-9a-f]"),
        "switches": F.size(F.split(body, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) / size,
        "puncts": share("[^A-Za-z0-9]"),
        "assigned": F.regexp_like(before, F.lit(r"[=:] ?[\"']?$")),
        "tight": F.regexp_like(before, F.lit(r"[=:][\"']?$")),
        "quoted": F.regexp_like(before, F.lit(r"[\"']$")),
    }
    values |= {f"cue_{k}": F.regexp_like(before, F.lit(words)) for k, words in CUES.items()}
    values |= {f"is_{k}": span["kind"] == k for k in GENERATORS}
    return F.struct(*[values[n].cast("double").alias(n) for n in FEATURES])


def candidates(text: Column) -> Column:
    """All proposed spans with features f; they may overlap each other and the base spans."""
    found = F.concat(*[_spans(text, kind, pattern) for kind, pattern in GENERATORS.items()])
    return F.transform(found, lambda s: F.struct(s.alias("s"), candidate_features(s).alias("f")))


def training_texts(n: int, seed: int) -> list[tuple[str, str, int, int]]:
    """n generated texts, every other one with personal data of a kind from start to end; the rest ('', 0, 0) only look like it."""
    rng = random.Random(seed)
    some = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexes = lambda k: some("0123456789abcdef", k)
    alnum = lambda k: some(lower + lower.upper() + digits, k)
    base64 = lambda k: some(lower + lower.upper() + digits + "+/", k) + rng.choice(["", "=", "=="])
    key = lambda k: rng.choice(["AKIA", "ASIA", "AKIAI"]) + some(lower.upper() + rng.choice(["7", "234567", digits]), k - 1) + num(1)
    prefixed = lambda k: rng.choice(["ghp_", "sk-", "sk_live_", "xoxb-"]) + alnum(k)
    num = lambda k: some(digits, k)
    word = lambda: some("abcdefghilmnoprstu", rng.randrange(2, 9))
    phrase = lambda: word() + word() + word() + rng.choice(["", num(2), "!" + num(1), "-" + word()])
    cues = ["password=", "pwd: ", "secret = ", "my token = \"", "api_key=", "access key: ", "auth: ", "password: \"", "passwd=", "TOKEN="]
    good = [
        lambda: ("secret", rng.choice(cues), rng.choice([hexes, alnum, base64, prefixed])(rng.randrange(12, 48))),
        lambda: ("secret", rng.choice(["token = \"", "auth: "]), hexes(40)),
        lambda: ("secret", rng.choice([word() + " ", "key ", "use "]), rng.choice([lambda: key(16), lambda: prefixed(rng.randrange(24, 40)), lambda: alnum(rng.randrange(16, 64)), lambda: base64(40)])()),
        lambda: ("secret", rng.choice(["my password is ", "the token was ", "secret "]), alnum(rng.randrange(16, 48)) + num(1)),
        lambda: ("secret", rng.choice(["password=", "pwd=", "passwd=", "secret=\"", "password:"]), phrase()),
        lambda: ("local_phone", rng.choice(["call ", "phone ", "tel. ", "fax: ", ""]), f"({num(3)}) {num(3)}-{num(4)}"),
        lambda: ("local_phone", rng.choice(["mobile ", "contact ", "tel "]), f"{num(3)}{rng.choice('-. ')}{num(3)}-{num(4)}"),
        lambda: ("local_phone", rng.choice(["call ", "phone ", "tel. ", "fax: ", "mobile "]), rng.choice([lambda: f"0{num(2)} {num(4)} {num(4)}", lambda: f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", lambda: f"0{num(3)}/{num(7)}"])()),
        lambda: ("ipv6", rng.choice(["host ", "from ", "ip ", ""]), ":".join(hexes(4) for _ in range(8)) if rng.random() < 0.5 else f"2001:db8::{hexes(3)}:{hexes(4)}"),
        lambda: ("jwt", rng.choice(["bearer ", "token ", ""]), f"eyJ{alnum(20)}.eyJ{alnum(40)}.{alnum(43)}"),
        lambda: ("ssn", rng.choice(["ssn ", "social security ", "ssn: "]), f"{num(3)}-{num(2)}-{num(4)}"),
        lambda: ("iban", rng.choice(["iban ", "account ", "bank: "]), f"DE{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}"),
        lambda: ("spelt_email", rng.choice(["mail ", "write to ", "", "contact "]), f"{word()} {rng.choice(['(at)', '[at]'])} {word()} {rng.choice(['.', '(dot)', '[dot]'])} com"),
    ]
    bad = [
        lambda: f"{word()} " + num(rng.randrange(4, 9)),
        lambda: f"{word()} v{num(1)}{word()}{num(2)}",
        lambda: f"{word()} commit " + hexes(rng.choice([7, 8, 12])),
        lambda: f"part {word()}" + alnum(4) + num(3),
        lambda: f"order {num(3)} {num(3)} {num(4)}",
        lambda: f"{word()} {word()} {num(3)}-{num(2)}-{num(4)} {word()}",
        lambda: f"isbn {num(13)}",
        lambda: f"model AB{num(2)} {alnum(4).upper()} {alnum(4).upper()}",
        lambda: f"on 20{num(2)}-0{num(1)}-1{num(1)}" + rng.choice(["", f"T1{num(1)}", f"_{word()}"]),
        lambda: f"{rng.choice(['/', 'see ', 'https://'])}{word()}/{word()}{num(2)}/{word()}-{num(3)}",
        lambda: f"{word()}-{num(2)}-{word()}-{word()}" if rng.random() < 0.5 else f"{word()}_{word()}_{word()}{num(1)}",
        lambda: f"{word()}{word()}{word()}{num(rng.randrange(1, 6))}" + rng.choice(["", word()]),
        lambda: f"{word()}{num(rng.randrange(5, 10))} {word()}.{word()}/{word()}/{num(5)}.htm",
        lambda: f"{word()} 0{num(2)} {num(3)} {num(3)} {word()}",
        lambda: f"at {num(2)}:{num(2)}:{num(2)} {word()}",
        lambda: f"mac {':'.join(hexes(2) for _ in range(6))}",
        lambda: f"the {rng.choice(['secret', 'token', 'password', 'auth'])}{rng.choice([': ', ' : '])}{word()}{word()} {word()}",
    ]
    out = []
    for i in range(n):
        before, after = f"{word()} {word()} ", f" {word()}."
        if i % 2:
            kind, cue, body = rng.choice(good)()
            start = len(before) + len(cue)
            out.append((before + cue + body + ("\"" if cue.endswith("\"") else "") + after, kind, start, start + len(body)))
        else:
            out.append((before + rng.choice(bad)() + after, "", 0, 0))
    return out


def other_texts(n: int, seed: int) -> list[tuple[str, str, int, int]]:
    """n texts as those of training_texts(), in longer sentences and with cues, letters and neighbours that it does not use."""
    rng = random.Random(seed)
    some = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    vowels, consonants, digits = "aeiou", "bcdfglmnprstvz", "0123456789"
    name = lambda: "".join(rng.choice(consonants) + rng.choice(vowels) for _ in range(rng.randrange(1, 5)))
    num = lambda k: some(digits, k)
    mixed = lambda k: some("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k)
    sentence = lambda: " ".join(name() for _ in range(rng.randrange(3, 9)))
    good = [
        lambda: ("secret", rng.choice(["DB_PASSWORD=", "client_secret: ", "\"token\": \"", "api-key = "]), rng.choice([mixed(24), some("0123456789abcdef", 32), name() + num(3) + "!" + name() + "x", mixed(12) + "/" + mixed(12) + "+" + num(2) + "a"])),
        lambda: ("secret", "the credential is ", mixed(rng.randrange(24, 44)) + num(2)),
        lambda: ("local_phone", rng.choice(["you can ring ", "my cell ", "telephone ", "fax "]), rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(1)}.{num(2)}.{num(2)}.{num(2)}.{num(2)}"])),
        lambda: ("ssn", rng.choice(["his social security no. ", "SSN# "]), f"{num(3)}-{num(2)}-{num(4)}"),
        lambda: ("iban", rng.choice(["to the account ", "IBAN: "]), rng.choice([f"GB{num(2)} {some('ABCDEFG', 4)} {num(4)} {num(4)} {num(4)} {num(2)}", f"FR{num(2)}{num(4)}{num(4)}{num(4)}{num(4)}{num(4)}{num(3)}"])),
        lambda: ("spelt_email", rng.choice(["reach me under ", "mail to "]), f"{name()}.{name()} (at) {name()} (dot) org"),
        lambda: ("ipv6", rng.choice(["listening on ", "address "]), f"fe80::{some('0123456789abcdef', 4)}:{num(4)}:{some('abcdef', 4)}:{num(2)}"),
        lambda: ("jwt", rng.choice(["Authorization: Bearer ", "id "]), f"eyJ{mixed(33)}.eyJ{mixed(60)}.{mixed(43)}"),
    ]
    bad = [
        lambda: f"version {num(1)}.{num(2)}.{num(1)}-rc{num(1)}",
        lambda: f"{name()}_{name()}{num(2)} and {name()}-{num(4)}-{name()}",
        lambda: f"between 0{num(1)} {num(2)} and 0{num(1)} {num(2)} {name()}",
        lambda: f"see http://{name()}.com/{name()}/{num(6)}.html",
        lambda: f"{num(3)} {num(3)} {num(4)} people",
        lambda: f"on 19{num(2)}-1{num(1)}-2{num(1)} at 1{num(1)}:{num(2)}:{num(2)}",
        lambda: f"the password {name()} {name()} was {name()}",
        lambda: f"build{num(8)} of {name()}{num(5)}{name()}",
        lambda: f"item {num(3)}-{num(2)}-{num(4)} of the list",
    ]
    out = []
    for i in range(n):
        before = sentence() + " "
        if i % 2:
            kind, cue, body = rng.choice(good)()
            start = len(before) + len(cue)
            out.append((before + cue + body + ("\"" if cue.endswith("\"") else "") + " " + sentence(), kind, start, start + len(body)))
        else:
            out.append((before + rng.choice(bad)() + " " + sentence(), "", 0, 0))
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 48, rate: float = 0.3) -> tuple[float, list[dict]]:
    """Gradient boosting of trees of depth 3 for the logistic loss."""

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        best = (1e-6, None, None)
        for j in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[rows, j], [0.1, 0.25, 0.5, 0.75, 0.9])):
                left = rows[x[rows, j] <= cut]
                right = rows[x[rows, j] > cut]
                if len(left) >= 5 and len(right) >= 5:
                    gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    if gain > best[0]:
                        best = (gain, j, float(cut))
        return best[1:]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> dict:
        j, cut = split(rows, g, h) if depth else (None, None)
        if j is None:
            return {"value": float(rate * g[rows].sum() / (h[rows].sum() + 1))}
        return {"feature": int(j), "cut": cut, "left": grow(rows[x[rows, j] <= cut], g, h, depth - 1), "right": grow(rows[x[rows, j] > cut], g, h, depth - 1)}

    bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    score, trees = np.full(len(y), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.arange(len(y)), y - p, p * (1 - p), 3))
        score += predict(trees[-1:], x)
    return bias, trees


def predict(trees: list[dict], x: np.ndarray) -> np.ndarray:
    def value(node: dict, rows: np.ndarray) -> np.ndarray:
        if "value" in node:
            return np.full(len(rows), node["value"])
        return np.where(rows[:, node["feature"]] <= node["cut"], value(node["left"], rows), value(node["right"], rows))

    return sum((value(t, x) for t in trees), np.zeros(len(x)))


def score_sql(bias: float, trees: list[dict], struct: str) -> str:
    def value(node: dict) -> str:
        if "value" in node:
            return f"{node['value']!r}D"
        return f"CASE WHEN {struct}.{FEATURES[node['feature']]} <= {node['cut']!r}D THEN {value(node['left'])} ELSE {value(node['right'])} END"

    return " + ".join([f"{bias!r}D", *(f"({value(t)})" for t in trees)])


def fitted_score(spark, n_train: int = 1500, seed: int = 3, precision: float = 0.98, keep: float = 0.97) -> tuple[str, dict[str, float], dict[str, float]]:
    """(score expression over candidate c, threshold a kind, recall a kind): fitted on n_train generated texts, calibrated on as many others.

    A third of the calibration texts is of the fitting generator, the rest in writings that it does not make (other_texts). The threshold of a kind is the
    greatest that keeps that share of its good candidates, but none below the precision; recall is of all its planted spans, and one that no generator
    proposes is a miss.
    """
    texts = training_texts(n_train + n_train // 3, seed) + other_texts(n_train, seed + 1)
    given = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"id": i, "text": t[0]} for i, t in enumerate(texts)])), "array<struct<id:int,text:string>>")).alias("t")).select("t.*")
    rows = given.select("id", F.explode(candidates(F.col("text"))).alias("c")).select("id", "c.s.kind", "c.s.start", "c.s.end", *[f"c.f.{n}" for n in FEATURES]).orderBy("id", "kind", "start", "end").collect()
    ids, kinds = np.array([r["id"] for r in rows]), np.array([r["kind"] for r in rows])
    y = np.array([float((r["kind"], r["start"], r["end"]) == texts[r["id"]][1:]) for r in rows])
    x = np.array([[float(v) for v in r[4:]] for r in rows])
    # What lies in or across a planted span without being it is neither good nor bad.
    clear = np.array([y[i] > 0 or not texts[r["id"]][1] or r["end"] <= texts[r["id"]][2] or r["start"] >= texts[r["id"]][3] for i, r in enumerate(rows)])
    fit = ids < n_train
    bias, trees = fit_trees(x[fit & clear], y[fit & clear])
    scores = bias + predict(trees, x)
    thresholds, recall = {}, {}
    for kind in GENERATORS:
        own = ~fit & clear & (kinds == kind)
        planted = max(1, sum(t[1] == kind for t in texts[n_train:]))
        precise = next((t for t in sorted(scores[own]) if y[own][scores[own] >= t].mean() >= precision), 1e9)
        good = np.sort(scores[own & (y > 0)])
        thresholds[kind] = float(max(precise, good[int(len(good) * (1 - keep))])) if len(good) else 1e9
        recall[kind] = float(y[own][scores[own] >= thresholds[kind]].sum() / planted)
    return score_sql(bias, trees, "c.f"), thresholds, recall


def _outermost(spans: Column) -> Column:
    """Sorted spans without those that lie inside an earlier one; of equal extents the kind listed first stays."""
    kind = f"struct<s:{SPAN},ok:boolean>"
    step = lambda reach, s: (F.greatest(reach, s["end"]), F.struct(s.alias("s"), (s["end"] > reach).alias("ok")))
    return F.transform(F.filter(scan(spans, F.lit(0), step, kind), lambda x: x["ok"]), lambda x: x["s"])


def _clear_of(base: Column, found: Column) -> Column:
    """The spans of found that overlap none of base; both are sorted by start. Two sweeps: the furthest end before, the next start after."""
    tag = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s.alias("s")))
    merged = F.array_sort(F.concat(tag(base, 0), tag(found, 1)))
    kind = f"struct<start:int,own:int,s:{SPAN},ok:boolean>"

    def forward(reach: Column, x: Column) -> tuple[Column, Column]:
        out = F.struct(x["start"].alias("start"), x["own"].alias("own"), x["s"].alias("s"), (x["start"] >= reach).alias("ok"))
        return F.when(x["own"] == 0, F.greatest(reach, x["s"]["end"])).otherwise(reach), out

    def backward(following: Column, x: Column) -> tuple[Column, Column]:
        out = F.struct(x["start"].alias("start"), x["own"].alias("own"), x["s"].alias("s"), (x["ok"] & (x["s"]["end"] <= following)).alias("ok"))
        return F.when(x["own"] == 0, x["start"]).otherwise(following), out

    swept = scan(F.reverse(scan(merged, F.lit(0), forward, kind)), F.lit(2**31 - 1), backward, kind)
    return F.transform(F.filter(F.reverse(swept), lambda x: (x["own"] == 1) & x["ok"]), lambda x: x["s"])


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base_spans and spans, arrays of (start, end, kind, body) in code points, end exclusive, by start and then kind.

    spans holds all base spans and the accepted candidates that overlap no base span; of accepted candidates one that lies inside another goes,
    others that overlap stay. A null text is empty. Rows come back one for one, whatever their ids; base_spans and spans replace columns of these names.
    """
    expression, thresholds, _ = fitted_score(docs.sparkSession)
    least = "CASE c.s.kind " + " ".join(f"WHEN '{k}' THEN {t!r}D" for k, t in thresholds.items()) + " END"
    own = free_prefix(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumns({f"{own}base": base_spans(text), f"{own}found": candidates(text)})
    accepted = _outermost(_by_start(F.transform(F.expr(f"filter({own}found, c -> ({expression}) >= {least})"), lambda c: c["s"])))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "kind", "body")]))
    clear = F.when(F.size(f"{own}base") == 0, accepted).otherwise(_clear_of(F.col(f"{own}base"), accepted))
    found = F.when(F.size(f"{own}found") == 0, F.col(f"{own}base")).otherwise(_by_start(F.concat(f"{own}base", clear)))
    return out.withColumns({"base_spans": plain(F.col(f"{own}base")), "spans": plain(found)}).drop(f"{own}base", f"{own}found")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Spans whose stretch of text is cut out at once.
CUT = 128


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    kind = "struct<start:int,end:int,kind:string,from:int>"

    def reach(at: Column, s: Column) -> tuple[Column, Column]:
        """Spans inside earlier ones only move the end; from is where the text before a span begins."""
        out = F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["start"] >= at, s["kind"]).alias("kind"), at.alias("from"))
        return F.greatest(at, s["end"]), out

    def part(whole: Column, some: Column) -> Column:
        """A stretch of the text is cut out once, and its pieces from it."""
        first = F.element_at(some, 1)["from"]
        pieces = lambda cut: F.array_join(F.transform(some, lambda m: F.when(m["kind"].isNull(), "").otherwise(F.concat(F.substring(cut, m["from"] - first + 1, m["start"] - m["from"]), F.lit("["), F.upper(m["kind"]), F.lit("]")))), "")
        return let(F.substring(whole, first + 1, F.element_at(some, -1)["start"] - first), pieces)

    def over(whole: Column, all_spans: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(all_spans), F.lit(CUT)), lambda at: let(F.slice(all_spans, at, CUT), lambda some: part(whole, some)))
        end = F.aggregate(all_spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
        return F.concat(F.array_join(blocks, ""), F.substring(whole, end + 1, F.length(whole)))

    whole = F.coalesce(text, F.lit(""))
    return F.when(F.size(spans) == 0, whole).otherwise(let(whole, lambda w: let(scan(spans, F.lit(0), reach, kind), lambda all_spans: over(w, all_spans))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the spans of text_col replaced; a null text stays null."""
    out = find_spans(docs, text_col)
    return out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.when(F.size("spans") == 0, F.col(text_col)).otherwise(redacted(F.col(text_col), F.col("spans"))))).drop("base_spans", "spans")
