"""Source frames from plain rows, and a plain-Python reading of the dataset rules."""

from __future__ import annotations

import random
import re
from datetime import date, datetime, timedelta

from cohortlens.sources.tables import Sources

SCHEMAS = {
    "leads": "accountid string, opp_id string, createddate timestamp_ntz, country string, origen string",
    "accounts": "id string, personmobilephone string, createddate timestamp_ntz",
    "reservations": "account string, opportunity string, paymentdate timestamp_ntz, status string, country string",
    "stage_history": "opportunityid string, createddate timestamp_ntz, field string, newvalue string",
    "opportunities": "id string, accountid string, country string, recordtypename string",
    "register_funnel": (
        "opportunity_id string, fecha_registro timestamp_ntz, fecha_inspeccion_agendada timestamp_ntz, "
        "country_iso string, flag_register boolean, flag_online_schedule boolean, km string"
    ),
}


def make_sources(spark, **rows) -> Sources:
    return Sources(**{n: spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()})


def at(text: str, hour: int = 10) -> datetime:
    return datetime.fromisoformat(text) + timedelta(hours=hour)


def random_rows(seed: int, users: int = 12, hot: bool = False) -> dict[str, list[tuple]]:
    """Messy rows with NULLs, repeats and ties; ``hot`` gives one user a third of everything."""
    rng = random.Random(seed)
    pick = rng.choice

    def user():
        if hot and rng.random() < 0.34:
            return "u0"
        return pick([f"u{i}" for i in range(users)] + [None])

    def day(low=date(2024, 12, 20), span=320):
        if rng.random() < 0.05:
            return None
        return datetime.combine(low, datetime.min.time()) + timedelta(
            days=rng.randrange(span), hours=rng.randrange(24)
        )

    opps = [f"o{i}" for i in range(users * 3)]
    kms = ["10000", "12.500 km", "15750", "", "km", None, "0", "9" * 22, "-5", "700"]
    rows = {
        "leads": [
            (user(), pick(opps + [None]), day(), pick(["AR", "AR", "MX", None]), pick(["web", "web", "Meli wpp", None]))
            for _ in range(users * 8)
        ],
        "accounts": [
            (f"u{i}", pick(["+54 11", "+54 9", "+52 55", None]), day()) for i in range(users)
        ] + [("u1", "+54 1", day())],
        "reservations": [
            (user(), pick(opps + [None]), day(), pick(["Capturada", "Capturada", "Nula"]), pick(["AR", "MX"]))
            for _ in range(users * 6)
        ],
        "opportunities": [
            (o, user(), pick(["AR", "AR", "AR", "MX", None]),
             pick(["Ventas_ARG", "Sales_Global", "Compras", "Supply_Global", "Otro", None]))
            for o in opps
        ],
        "stage_history": [
            (pick(opps + [None]), day(), pick(["StageName", "StageName", "Owner"]), pick(["Cerrada ganada", "Abierta", None]))
            for _ in range(users * 6)
        ],
        "register_funnel": [
            (pick(opps + ["missing", None]), day(), pick([None, day()]), pick(["AR", "AR", "MX"]),
             pick([True, True, False, None]), pick([True, True, False, None]), pick(kms))
            for _ in range(users * 12)
        ],
    }
    rows["register_funnel"] += rows["register_funnel"][:10]
    rows["leads"] += rows["leads"][:10]
    rows["opportunities"] += rows["opportunities"][:3]
    # One opportunity of two accounts, and one account's opportunity with two record types.
    rows["opportunities"] += [(opps[0], "u2", "AR", "Compras"), (opps[1], "u3", "AR", "Otro"),
                              (opps[1], "u3", "AR", "Sales_Global")]
    if hot:
        rows["register_funnel"] += [rows["register_funnel"][0]] * 200
    return rows


def _date(stamp):
    return None if stamp is None else stamp.date()


def digits(text):
    kept = re.sub("[^0-9]", "", text or "")
    return int(kept) if kept and int(kept) < 2**63 else None


def integer(text):
    ok = text is not None and re.fullmatch(r"\s*[+-]?[0-9]+\s*", text) and abs(int(text)) < 2**63
    return int(text) if ok else None


def streams(rows: dict, parse) -> dict[str, set]:
    """Distinct events by stream, with plain loops."""
    phones = {(a, p) for a, p, _ in rows["accounts"]}
    eligible = {a for a, p in phones if p is not None and "+52" not in p}
    owner = {}
    for o, a, c, t in rows["opportunities"]:
        owner.setdefault(o, set()).add((a, c, t))
    out = {k: set() for k in ("lead", "booking", "register", "registerkm", "schedule", "tx")}
    for a, o, d, c, g in rows["leads"]:
        if c == "AR" and g is not None and g != "Meli wpp" and a in eligible:
            out["lead"].add((a, o, _date(d)))
    for a, o, d, s, c in rows["reservations"]:
        if s == "Capturada" and c == "AR" and a is not None and o is not None:
            out["booking"].add((a, o, _date(d)))
    for o, d, i, c, f, g, km in rows["register_funnel"]:
        for a, _, _ in owner.get(o, ()):
            if c != "AR" or a is None:
                continue
            out["register"].add((a, o, _date(d)))
            out["registerkm"].add((a, o, _date(d), parse(km)))
            if f and g:
                out["schedule"].add((a, o, _date(i) or _date(d)))
    for o, d, f, v in rows["stage_history"]:
        for a, c, t in owner.get(o, ()):
            if (f, v, c) == ("StageName", "Cerrada ganada", "AR") and a is not None and t in (
                "Ventas_ARG", "Sales_Global", "Compras", "Supply_Global"
            ):
                out["tx"].add((a, o, _date(d)))
    return out


def expected_dataset(rows: dict, periods, parse, km_in_key: bool, skip_null: bool) -> dict:
    """(set, user) -> counts, recencies, last km and label."""
    ev = streams(rows, parse)
    signals = {k: ev[k] for k in ("lead", "booking", "register", "schedule")}
    if km_in_key:
        signals["register"] = ev["registerkm"]
    out = {}
    for p in periods:
        inside = lambda d, a, b: d is not None and a <= d < b
        users = {
            e[0] for s in signals.values() for e in s if inside(e[2], p.period_start, p.period_end_excl)
        }
        for u in users:
            row = {}
            for kind, events in signals.items():
                days = [e[2] for e in events if e[0] == u and inside(e[2], p.period_start, p.period_end_excl)]
                row[f"n_{kind}"] = len(days)
                row[f"rec_{kind}"] = (p.period_end_excl - max(days)).days if days else None
            readings = [
                (e[2], e[3]) for e in ev["registerkm"]
                if e[0] == u and inside(e[2], p.period_start, p.period_end_excl)
                and not (skip_null and e[3] is None)
            ]
            newest = max((d for d, _ in readings), default=None)
            row["km"] = max((k for d, k in readings if d == newest and k is not None), default=None)
            row["label"] = int(any(
                e[0] == u and inside(e[2], p.label_start, p.label_end_excl) for e in ev["tx"]
            ))
            out[p.set, u] = row
    return out
