"""Confirming classifications: against a plain run, decision by decision, and twice."""

import random
from decimal import Decimal as D

from tallyforge.operators import confirmation, store, versions

KINDS = {
    "products": "id string, display_name string, normalized_name string, brand string, barcode string, unit string, category_id string",
    "aliases": "product_id string, original_text string, normalized_text string, supplier_id string",
    "suppliers": "id string, name string, aliases array<string>",
    "lines": "id string, process_id string, description string, original_text string, line_total decimal(18,2), product_id string, review_status string",
    "processes": "id string, supplier_id string, confirmed boolean",
    "audit": "entity_id string, action string, lines bigint, products bigint",
}
REQUESTS = "process_id string, supplier_id string, supplier_name string"
DECISIONS = "process_id string, position int, line_id string, action string, product_id string, description string, original_text string, category_id string, line_total decimal(18,2)"
DELETED = "process_id string, line_id string"


def norm(t):
    return " ".join("".join(" " if c in ".,-" else c for c in t.upper()).split())


def clean(t):
    kept = " ".join(w for w in norm(t).split() if w != "ART")
    return kept or norm(t)


def plain(tables, requests, decisions):
    products = {p[2]: p[0] for p in tables["products"]}
    aliases = [(a[0], a[1], a[2]) for a in tables["aliases"]]
    made, names = [], {}
    open_ = {p[0] for p in tables["processes"] if not p[2]}
    final = {}
    for d in sorted(decisions, key=lambda d: (d[0], d[1])):
        if d[0] not in open_ or d[0] not in {r[0] for r in requests}:
            continue
        raw = d[5] or d[6] or ""
        product = d[4] if d[3] == "link_existing" else None
        if d[3] == "create_new":
            name = clean(raw)
            if name not in products:
                products[name] = f"new {name}"
                names[name] = d[5] or raw
            product = products[name]
        final[(d[0], d[1])] = product
        known = any(a[0] == product and (a[2] == norm(raw) or a[1].upper().strip() == raw.upper().strip()) for a in aliases)
        if product is not None and not known and len(norm(raw)) > 1:
            aliases.append((product, d[6] or d[5], norm(raw)))
            made.append(aliases[-1])
    return names, sorted(made), final


def test_equal_to_one_decision_after_the_other(spark, tmp_path):
    rng = random.Random(8)
    texts = ["Latte intero", "latte  intero", "LATTE.INTERO ", "Latte art intero", "Pane", "pane-", "Pane di casa", "x", "Vino rosso"]
    originals = [None, "", "pane", "LATTE INTERO", "altro testo"]
    tables = {
        "products": [("p1", "Pane", "PANE", None, None, None, None)],
        "aliases": [("p1", "vecchio pane", "VECCHIO PANE", None), ("p1", " pane di casa", "ALTRO", None)],
        "suppliers": [("s1", "Forno Rossi", ["il forno"])],
        "lines": [(f"l{i}", f"r{i % 5}", "old", "old", D(1), None, "proposed") for i in range(20)],
        "processes": [(f"r{i}", None, i == 4) for i in range(6)],
        "audit": [],
    }
    decisions = []
    for p in range(7):  # r6 is no process
        for k in range(12):
            action = rng.choice(["link_existing", "create_new", "create_new", "skip"])
            line = rng.choice([None, f"temp-line-{k}", f"l{p + 5 * (k % 3)}"]) if k < 3 else None
            decisions.append((f"r{p}", k, line, action, rng.choice(["p1", "p9"]) if action == "link_existing" else None, rng.choice(texts), rng.choice(originals), None, D(k)))
    requests = [("r0", None, " IL FORNO "), ("r1", "new", "Bottega"), ("r2", "", "bottega "), ("r3", "s7", "Forno Rossi"), ("r4", None, "Nobody"), ("r6", None, "Ghost"), ("r5", None, None), ("r5", None, None)]
    deleted = [("r0", "l15"), ("r4", "l4"), ("r1", None)]
    frames = {t: spark.createDataFrame(rows, KINDS[t]) for t, rows in tables.items()}
    args = spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(decisions, DECISIONS), spark.createDataFrame(deleted, DELETED)
    names, made, final = plain(tables, requests, decisions)
    root = str(tmp_path)
    store.publish(frames, root)
    for n in (2, 3):  # the second time changes nothing
        assert confirmation.confirmed(spark, root, *args) == n
        now = {t: versions.snapshot(spark, root).read(t).collect() for t in KINDS}
        ids = {r.id: f"new {r.normalized_name}" for r in now["products"] if r.id.startswith("prod-")}
        assert {r.normalized_name: r.display_name for r in now["products"] if r.id in ids} == names and len(now["products"]) == 1 + len(names)
        assert sorted((ids.get(a.product_id, a.product_id), a.original_text, a.normalized_text) for a in now["aliases"]) == sorted([(a[0], a[1], a[2]) for a in tables["aliases"]] + made)
        stored = {r.id: r for r in now["lines"]}
        assert "l15" not in stored and stored["l4"].review_status == "proposed"  # deleted; of a process that was confirmed before
        for d in decisions:
            if (d[0], d[1]) in final and (d[2] is None or d[2].startswith("temp")):
                r = stored[f"line-{d[0]}-{d[1]}"]
                assert (ids.get(r.product_id, r.product_id), r.description, r.review_status) == (final[(d[0], d[1])], d[5], "confirmed")
        changed = {d[2]: d for d in decisions if (d[0], d[1]) in final and d[2] and d[2].startswith("l") and d[2] in stored}
        assert changed and all((stored[i].description, stored[i].line_total, stored[i].review_status) == (d[5], d[8], "confirmed") for i, d in changed.items())
        by_id = {r.id: r for r in now["processes"]}
        bottega = [s for s in now["suppliers"] if s.id.startswith("sup-")]
        assert [s.name.lower() for s in bottega] == ["bottega"]
        assert [(by_id[f"r{i}"].supplier_id, by_id[f"r{i}"].confirmed) for i in range(6)] == [("s1", True), (bottega[0].id, True), (bottega[0].id, True), ("s7", True), (None, True), (None, True)]
        assert sorted((a.entity_id, a.lines) for a in now["audit"]) == [(f"r{i}", 12) for i in (0, 1, 2, 3, 5)] and sum(a.products for a in now["audit"]) == len(names)


def test_nothing_to_confirm(spark):
    frames = {t: spark.createDataFrame([], k) for t, k in KINDS.items()}
    got = confirmation.confirm(frames, spark.createDataFrame([("r1", None, "x")], REQUESTS), spark.createDataFrame([], DECISIONS), spark.createDataFrame([], DELETED))
    assert {t: df.count() for t, df in got.items()} == dict.fromkeys(KINDS, 0)
    assert all(got[t].columns == frames[t].columns for t in KINDS)


def test_decisions_are_resolved_once(spark, tmp_path, monkeypatch):
    frames = {t: spark.createDataFrame([], k) for t, k in KINDS.items()} | {"processes": spark.createDataFrame([("r1", None, None)], KINDS["processes"])}
    args = (
        spark.createDataFrame([("r1", None, "x"), ("r2", None, "y")], REQUESTS), spark.createDataFrame([("r1", 0, None, "create_new", None, "Pane", None, None, D(1))], DECISIONS),
        spark.createDataFrame([], DELETED),
    )
    kept = []
    monkeypatch.setattr(confirmation, "saved", lambda df, label: kept.append(label) or df)
    store.publish(frames, str(tmp_path))
    seen = []
    for n in (2, 3):
        assert confirmation.confirmed(spark, str(tmp_path), *args) == n
        seen.append(versions.snapshot(spark, str(tmp_path)).tables)
    assert kept.count("decisions") == 1 and seen[0] == seen[1]  # the second time nothing is written
