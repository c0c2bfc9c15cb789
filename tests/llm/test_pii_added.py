"""Spans that the trees add: planted forms that no rule matches, in texts beside others with plain personal data."""

import random

from pyspark.sql import functions as F

from citeplane.llm import pii


def luhn(digits):
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(digits))
    return digits + str(-total % 10)


def planted(rng):
    """(text, kind and form or None) of one document."""
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    user, host, card = word() + d(2), word() + ".example.com", luhn("4" + d(14))
    a, b, c = "2" + d(2), d(3), d(4)
    ip = ".".join(str(rng.randrange(256)) for _ in range(4))
    plain = {"email": f"{user}@{host}", "ip": ip, "card": card, "phone": f"+1 ({a}) {b}-{c}"}
    hidden = {
        "email": [f"{user} at {host.replace('.', ' dot ')}", f"{user}(at){host.replace('.', '(dot)')}", f"{user} [at] {host.replace('.', ' [dot] ')}"],
        "ip": [ip.replace(".", "[.]")],
        "card": [".".join(card[i : i + 4] for i in range(0, 16, 4))],
        "phone": [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"],
        "secret": [f"token = \"{rng.getrandbits(160):040x}\"", f"api_key: {rng.getrandbits(128):032x}"],
    }
    noise = [f"20{d(2)}-{d(2)}-{d(2)}", f"1.{d(3)}.{d(3)}", d(9), d(12), f"met at {word()}. {word().title()} went", "well-known-long-name", f"{rng.getrandbits(160):040x}", f"{d(1)}.{d(1)}.{d(2)}"]
    kind = rng.choice(list(hidden))
    choice = rng.randrange(3)
    lead = {"email": "mail ", "phone": "call ", "card": "card ", "ip": "host "}.get(kind, "")
    if choice == 0:
        return f"{prose(9)} {rng.choice(['call ', 'mail ', '', ''])}{rng.choice(list(plain.values()))} {prose(8)}", "plain", ""
    if choice == 1:
        form = rng.choice(hidden[kind])
        return f"{prose(9)} {lead}{form} {prose(8)}", kind, form.split(" = ")[-1].removeprefix("api_key: ").strip('"')
    return f"{prose(9)} {rng.choice(noise)} {prose(8)}", "clean", ""


def test_added(spark):
    rng = random.Random(31)
    rows = [(i, *planted(rng)) for i in range(3000)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string, kind string, form string"), ("doc_id", "text", "kind", "form"))
    added = F.filter("spans", lambda x: ~F.exists("base", lambda b: (b["k"] == x["k"]) & (b["s"] == x["s"]) & (b["e"] == x["e"])))
    rows = found.select("text", "kind", "form", added.alias("added"), F.size("base").alias("base"), F.size(F.array_intersect("base", "spans")).alias("stay")).collect()
    assert all(r["base"] == r["stay"] for r in rows)
    hit = {}
    for r in rows:
        if r["kind"] == "clean":
            assert not r["added"], r
        elif r["kind"] != "plain":
            start = r["text"].index(r["form"])
            right = any(pii.KINDS[x["k"]] == r["kind"] and x["s"] < start + len(r["form"]) and start < x["e"] for x in r["added"]) or (r["base"] and not r["added"])
            hit.setdefault(r["kind"], []).append(bool(right))
    assert set(hit) == set(pii.KINDS)
    assert all(sum(v) >= 0.9 * len(v) for v in hit.values()), {k: sum(v) / len(v) for k, v in hit.items()}
