"""Edits and rollbacks against a store that is changed in place, one edit at a time."""

import random

import pytest

from maploom.operators import edits as E

ENTITIES = "entity long, name string, locked boolean, deleted boolean"
EDITS = "entity long, revision long, us long, seq long, verb string, value string"
ALIASES = "entity long, alias string, source string, us long, seq long, epoch long"
REVISIONS = "revision long, parent long, us long, reason string"


class Store:
    def __init__(self, entities):
        self.now = {e: {"name": n, "locked": k, "deleted": d} for e, n, k, d in entities}
        self.aliases = {e: {} for e in self.now}
        self.versions = []

    def alias(self, e, alias, source):
        self.aliases[e].setdefault(alias.lower(), (alias, source))

    def record(self, e, revision, action):
        self.versions.append((e, revision, action, dict(self.now[e]), [a for a, _ in self.aliases[e].values()]))

    def edit(self, e, revision, us, seq, verb, value):
        value = (value or "").strip(" ")
        if us <= 0 or verb not in ("rename", "alias", "delete") or (verb != "delete" and not value):
            return "invalid"
        if e not in self.now or self.now[e]["deleted"]:
            return "unknown_or_deleted"
        if verb == "rename":
            if self.now[e]["name"].lower() != value.lower():
                self.alias(e, self.now[e]["name"], "previous_name")
            self.now[e].update(name=value, locked=True)
        elif verb == "alias":
            self.alias(e, value, "user")
        else:
            self.now[e]["deleted"] = True
        self.record(e, revision, {"rename": "user_name", "alias": "user_alias", "delete": "entity_deleted"}[verb])
        return None

    def rollback(self, target, new):
        for e in self.now:
            old = [v for v in self.versions if v[0] == e and v[1] <= target]
            if not old:
                self.now[e]["deleted"] = True
                continue
            self.now[e] = dict(old[-1][3])
            self.aliases[e] = {a.lower(): (a, "rollback") for a in old[-1][4]}
            self.record(e, new, "rollback_restore")


def _edits(rng, start, revision):
    out = []
    for i in range(60):
        verb = rng.choice(["rename", "rename", "alias", "alias", "alias", "delete", "paint"])
        if verb == "delete" and rng.random() < 0.6:
            verb = "alias"
        out.append((rng.randint(0, 9), revision + i // 30, start + i // 3, i, verb, rng.choice(["desk", "Desk", "chair ", " lamp", "", None, "table", "TABLE"])))
    out.append((1, revision, 0, 99, "rename", "early"))
    return out


def _same(spark, store, state, aliases):
    assert {r.entity: (r.name, r.locked, r.deleted) for r in state.collect()} == {e: (s["name"], s["locked"], s["deleted"]) for e, s in store.now.items()}
    got = {}
    for r in aliases.collect():
        got.setdefault(r.entity, set()).add((r.alias, r.source))
    assert got == {e: set(a.values()) for e, a in store.aliases.items() if a}


@pytest.mark.parametrize("seed", [1])
def test_edits_rollbacks_and_edits_again(spark, seed):
    rng = random.Random(seed)
    entities = [(e, f"thing{e}", False, e == 7) for e in range(8)]
    store = Store(entities)
    df = spark.createDataFrame(entities, ENTITIES)
    aliases, versions = spark.createDataFrame([], ALIASES), None
    revisions = [(r, r - 1 if r else None, r + 1, "step") for r in range(4)]
    epoch, state, start = 0, df, 100
    for target, first in ((2, 2), (5, 5), (3, 8)):
        edits = _edits(rng, start, first)
        want = {x[3]: store.edit(*x) for x in sorted(edits, key=lambda x: (x[2], x[3]))}
        log = E.edit_log(state, spark.createDataFrame(edits, EDITS), epoch)
        assert {r.seq: r.error for r in log.collect()} == want
        state = E.edited_entities(state, log).select("entity", "name", "locked", "deleted")
        aliases = E.edited_aliases(aliases, log)
        versions = E.log_versions(log) if versions is None else versions.unionByName(E.log_versions(log))
        _same(spark, store, state, aliases.filter(f"epoch = {epoch}"))
        revisions += [(r, r - 1, start, "step") for r in range(revisions[-1][0] + 1, first + 2)]
        r = E.rollback(state, aliases, versions, spark.createDataFrame(revisions, REVISIONS), target, start + 50)
        made = r["revisions"].collect()
        assert [tuple(x) for x in made] == [(first + 2, first + 1, start + 50, f"rollback_to_{target}")]
        before = len(store.versions)
        store.rollback(target, first + 2)
        audit = [(x.action, x.entity, x.revision) for x in r["audit"].collect()]
        assert sorted(audit, key=str) == sorted([("advance_revision", None, first + 2)] + [("rollback_restore", v[0], first + 2) for v in store.versions[before:]], key=str)
        revisions, epoch = revisions + [tuple(x) for x in made], first + 2
        # tables that a user would append to
        keep = lambda d, schema: spark.createDataFrame(d.collect(), schema)
        versions = keep(versions.unionByName(r["versions"]), versions.schema)
        aliases = keep(aliases.unionByName(r["aliases"]), ALIASES)
        state = keep(r["entities"].select("entity", "name", "locked", "deleted"), ENTITIES)
        _same(spark, store, state, aliases.filter(f"epoch = {epoch}"))
        start += 100


def test_wrong_target_and_empty(spark):
    e, none = spark.createDataFrame([], ENTITIES), spark.createDataFrame([], EDITS)
    log = E.edit_log(e, none)
    assert log.count() == E.edited_entities(e, log).count() == E.edited_aliases(spark.createDataFrame([], ALIASES), log).count() == 0
    rev = spark.createDataFrame([(0, None, 1, "start")], REVISIONS)
    for target, us in ((1, 5), (-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            E.rollback(e, spark.createDataFrame([], ALIASES), E.log_versions(log), rev, target, us)
