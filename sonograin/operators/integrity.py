"""Integrity of runs, records, links, events and entities: each function returns the rows that break a rule, with the fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank

KINDS = ("accepted", "excluded", "rejected")
STATUSES = ("running", "succeeded", "failed")


def _each_fault(rows: DataFrame, keys: list[str], faults: dict[str, Column]) -> DataFrame:
    """keys and fault, once for each condition that holds; an unknown condition doesn't hold."""
    named = F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in faults.items())))
    return rows.select(*keys, F.explode(named).alias("fault"))


def run_faults(runs: DataFrame, records: DataFrame) -> DataFrame:
    """run_id, fault for runs (run_id, status, discovered, accepted, excluded, rejected) against their records (run_id, kind).

    unknown_run: rows of a run that isn't listed; status: not one of the three; total: discovered is not the sum; accepted,
    excluded, rejected: the stated number is not that of the rows; failed_owns: a failed run with rows; unfinished: still
    running.  Null numbers count as 0; records are counted per run before the join.
    """
    counted = records.groupBy("run_id").agg(F.count("*").alias("_rows"), *(F.count_if(F.col("kind") == k).alias(f"_{k}") for k in KINDS))
    j = runs.withColumn("_listed", F.lit(True)).join(counted, "run_id", "full").fillna(0, ["discovered", *KINDS, "_rows", *(f"_{k}" for k in KINDS)])
    listed = F.col("_listed").isNotNull()
    return _each_fault(j, ["run_id"], {
        "unknown_run": ~listed,
        "status": listed & ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "total": listed & (F.col("discovered") != F.col("accepted") + F.col("excluded") + F.col("rejected")),
        **{k: listed & (F.col(k) != F.col(f"_{k}")) for k in KINDS},
        "failed_owns": (F.col("status") == "failed") & (F.col("_rows") > 0),
        "unfinished": F.col("status") == "running",
    })


def ownership_faults(records: DataFrame, links: DataFrame) -> DataFrame:
    """record_id, fault of records (record_id, file_id, run_id) whose file was not read by their run, by links (file_id, run_id).

    unowned: no file or no run; unlinked: that run never read that file.
    """
    known = links.select("file_id", "run_id").distinct().withColumn("_known", F.lit(True))
    j = records.join(known, ["file_id", "run_id"], "left")
    unowned = F.col("file_id").isNull() | F.col("run_id").isNull()
    return _each_fault(j, ["record_id"], {"unowned": unowned, "unlinked": ~unowned & F.col("_known").isNull()})


def stored_fingerprint_faults(records: DataFrame, fresh: Column, stored: str = "fingerprint") -> DataFrame:
    """The rows whose stored fingerprint is not the recomputed one; a missing one counts as different."""
    return records.where(~fresh.eqNullSafe(F.col(stored)))


def link_faults(records: DataFrame, links: DataFrame) -> DataFrame:
    """record_id, fault for accepted records (record_id) and links (event_id, record_id) to events.

    unlinked: a record that no event has; shared: a record of several events; dangling: a link to no record.
    """
    linked = links.groupBy("record_id").agg(F.countDistinct("event_id").alias("_events"))
    j = records.select("record_id").distinct().withColumn("_there", F.lit(True)).join(linked, "record_id", "full")
    there = F.col("_there").isNotNull()
    return _each_fault(j, ["record_id"], {"unlinked": there & F.col("_events").isNull(), "shared": there & (F.col("_events") > 1), "dangling": ~there})


def event_faults(events: DataFrame, links: DataFrame) -> DataFrame:
    """event_id, fault for events (event_id, started_ms, ended_ms, time_basis, status) and links (event_id, source).

    no_evidence: nothing linked; status: reconciled without both sources, or single with both; basis: unknown, or without
    the instant that it names; order: ends before it starts.
    """
    has = links.groupBy("event_id").agg(F.countDistinct("source").alias("_sources"))
    j = events.join(has, "event_id", "left")
    basis = F.when(F.col("time_basis") == "observed_start", F.col("started_ms").isNotNull()).when(F.col("time_basis") == "observed_end", F.col("ended_ms").isNotNull()).when(
        F.col("time_basis") == "derived_start", F.col("started_ms").isNotNull() & F.col("ended_ms").isNotNull()
    )
    return _each_fault(j, ["event_id"], {
        "no_evidence": F.col("_sources").isNull(),
        "status": (F.col("status") != "unresolved") & ((F.col("status") == "cross_source_reconciled") != (F.col("_sources") > 1)),
        "basis": ~F.coalesce(basis, F.lit(False)),
        "order": F.col("ended_ms") < F.col("started_ms"),
    })


def supersession_faults(events: DataFrame) -> DataFrame:
    """event_id, fault for events (event_id, state, superseded_by).

    no_successor: superseded, but by nothing; active_successor: active, yet succeeded; self: succeeds itself; missing: the
    successor isn't there; superseded_successor: the successor went too, so a reader must follow the chain.
    """
    there = events.select(F.col("event_id").alias("_id"), F.col("state").alias("_state")).distinct()
    j = events.join(there, F.col("superseded_by") == F.col("_id"), "left")
    gone, by = F.col("state") == "superseded", F.col("superseded_by")
    return _each_fault(j, ["event_id"], {
        "no_successor": gone & by.isNull(), "active_successor": ~gone & by.isNotNull(), "self": by == F.col("event_id"),
        "missing": by.isNotNull() & F.col("_id").isNull(), "superseded_successor": (F.col("_state") == "superseded") & (by != F.col("event_id")),
    })


def graph_faults(resolutions: DataFrame) -> DataFrame:
    """entity_type, entity_id, owners: tracks and releases of resolutions (artist_id, track_id, release_id) with several artists."""
    both = [resolutions.select(F.lit(t).alias("entity_type"), F.col(f"{t}_id").alias("entity_id"), "artist_id") for t in ("track", "release")]
    several = both[0].unionByName(both[1]).where("entity_id is not null").groupBy("entity_type", "entity_id").agg(F.countDistinct("artist_id").alias("owners"))
    return several.where("owners > 1")


def blank_versions(**tables: DataFrame) -> DataFrame:
    """table, blank, rows: how many rows of each table have a null or blank ``version``."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.lit(name).alias("table"), F.count_if(F.coalesce(F.trim("version"), F.lit("")) == "").alias("blank"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def _first(t: DataFrame, key: str, **columns: str) -> DataFrame:
    """One row a key, with other names for its columns."""
    return t.groupBy(F.col(key).alias(f"_{key}")).agg(*(F.first(c).alias(n) for n, c in columns.items()))


def file_run_faults(files: DataFrame, runs: DataFrame, commands: dict[str, str]) -> DataFrame:
    """file_id, fault for files (file_id, source_type, first_run_id, last_run_id) and runs (run_id, status, command, registered_files, noop_files).

    unknown_run; not_succeeded: either run; order: the last before the first; command: a run of another kind than
    ``commands`` has for the file's type; unregistered: one run that registered nothing; no_noop: a later run that passed
    over nothing.
    """
    r = lambda p: _first(runs, "run_id", **{f"{p}_{c}": c for c in ("status", "command", "registered_files", "noop_files")}).withColumnRenamed("_run_id", f"_{p}")
    j = files.join(r("a"), F.col("first_run_id") == F.col("_a"), "left").join(r("z"), F.col("last_run_id") == F.col("_z"), "left")
    want = F.create_map(*(F.lit(x) for kv in commands.items() for x in kv))[F.col("source_type")]
    once = F.col("first_run_id") == F.col("last_run_id")
    return _each_fault(j, ["file_id"], {
        "unknown_run": F.col("_a").isNull() | F.col("_z").isNull(), "not_succeeded": (F.col("a_status") != "succeeded") | (F.col("z_status") != "succeeded"), "order": F.col("first_run_id") > F.col("last_run_id"),
        "command": want.isNotNull() & ((F.col("a_command") != want) | (F.col("z_command") != want)), "unregistered": once & (F.col("a_registered_files") == 0), "no_noop": ~once & (F.col("z_noop_files") == 0),
    })


def rejection_ownership_faults(rejections: DataFrame, files: DataFrame, runs: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """rejection_id, fault for rejections (rejection_id, run_id, file_id, source): unknown_run, unknown_file, run (not the file's first), command, type.

    kinds: the command and the file type of each source.
    """
    j = rejections.join(_first(runs, "run_id", _command="command"), F.col("run_id") == F.col("_run_id"), "left").join(_first(files, "file_id", _type="source_type", _first_run="first_run_id"), F.col("file_id") == F.col("_file_id"), "left")
    want = lambda i: F.create_map(*(F.lit(x) for s, v in kinds.items() for x in (s, v[i])))[F.col("source")]
    return _each_fault(j, ["rejection_id"], {
        "unknown_run": F.col("_run_id").isNull(), "unknown_file": F.col("_file_id").isNull(), "run": F.col("run_id") != F.col("_first_run"), "command": F.col("_command") != want(0), "type": F.col("_type") != want(1),
    })


def sync_run_faults(runs: DataFrame, metadata: DataFrame) -> DataFrame:
    """run_id, fault of synchronizing runs (run_id, status, discovered, accepted) against metadata (run_id, completed, pages): missing, unexpected, fewer, no_pages."""
    j = runs.join(_first(metadata, "run_id", _completed="completed", _pages="pages"), F.col("run_id") == F.col("_run_id"), "left")
    there, done = F.col("_run_id").isNotNull(), F.col("status") == "succeeded"
    return _each_fault(j, ["run_id"], {"missing": done & ~there, "unexpected": ~done & there, "fewer": F.col("_completed") < F.greatest("discovered", "accepted"), "no_pages": F.col("_pages") == 0})


def cursor_faults(cursors: DataFrame, runs: DataFrame, metadata: DataFrame, fetched: DataFrame) -> DataFrame:
    """scope, fault of cursors (scope, run_id, boundary_ms, updated_ms) whose run isn't a succeeded synchronization with metadata, is newer than they are, or fetched up to another instant.

    runs: run_id, command, status, completed_ms; fetched: run_id, instant_ms.
    """
    top = fetched.groupBy(F.col("run_id").alias("_top_run")).agg(F.max("instant_ms").alias("_top"))
    j = cursors.join(_first(runs, "run_id", _command="command", _status="status", _done="completed_ms"), F.col("run_id") == F.col("_run_id"), "left").join(top, F.col("run_id") == F.col("_top_run"), "left")
    j = j.join(metadata.select(F.col("run_id").alias("_meta")).distinct(), F.col("run_id") == F.col("_meta"), "left")
    return _each_fault(j, ["scope"], {
        "unknown_run": F.col("_run_id").isNull(), "command": F.col("_command") != "sync", "status": F.col("_status") != "succeeded", "metadata": F.col("_meta").isNull(), "older": F.col("updated_ms") < F.col("_done"), "boundary": F.col("boundary_ms") != F.col("_top"),
    })


def origin_faults(occurrences: DataFrame, runs: DataFrame, payloads: DataFrame) -> DataFrame:
    """record_id, fault of occurrences (record_id, run_id, origin, payload_id) for runs (run_id, command) and payloads (payload_id, origin).

    run: an import that isn't of origin 'export' or a synchronization that isn't of 'api'; payload: an exported occurrence of
    a fetched payload, or a fetched payload under another record than its own.
    """
    j = occurrences.join(_first(runs, "run_id", _command="command"), F.col("run_id") == F.col("_run_id")).join(_first(payloads, "payload_id", _origin="origin"), F.col("payload_id") == F.col("_payload_id"))
    due = F.when(F.col("_command") == "import", "export").when(F.col("_command") == "sync", "api")
    api = F.col("_origin") == "api"
    return _each_fault(j, ["record_id"], {"run": F.col("origin") != due, "payload": F.when(F.col("origin") == "export", api).when(F.col("origin") == "api", api & (F.col("record_id") != F.col("payload_id")))})


def rejection_faults(rejections: DataFrame, codes: dict[str, list[str]], summary: str) -> DataFrame:
    """rejection_id, fault of rejections (rejection_id, source, error_code, summary, file_id, ordinal): summary (not the safe one), code (not one of the source's), provenance."""
    known = F.lit(False)
    for s, c in codes.items():
        known = known | ((F.col("source") == s) & F.col("error_code").isin(*c))
    return _each_fault(rejections, ["rejection_id"], {"summary": ~F.coalesce(F.col("summary") == summary, F.lit(False)), "code": ~F.coalesce(known, F.lit(False)), "provenance": F.col("file_id").isNull() | F.col("ordinal").isNull()})


def state_faults(resolutions: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """record_id, event_id of records (record_id, kind) that disagree with their event (event_id, event_status) on being unresolved."""
    j = links.select("record_id", "event_id").join(resolutions.select("record_id", "kind"), "record_id").join(events.select("event_id", "event_status"), "event_id")
    new = F.col("kind") == "new_unresolved"
    return j.where((new & ~F.col("event_status").isin("unresolved", "superseded")) | (~new & (F.col("event_status") == "unresolved"))).select("record_id", "event_id")


def subtype_faults(entities: DataFrame, **subtypes: DataFrame) -> DataFrame:
    """entity_id, fault of entities (entity_id, entity_type): missing (no row of its subtype), other (a row of another one)."""
    j = entities
    for name, t in subtypes.items():
        j = j.join(t.select(F.col("entity_id").alias("entity_id"), F.lit(True).alias(f"_{name}")).distinct(), "entity_id", "left")
    has = {n: F.col(f"_{n}").isNotNull() for n in subtypes}
    own = lambda n: F.col("entity_type") == n
    missing, other = F.lit(False), F.lit(False)
    for n in subtypes:
        missing = missing | (own(n) & ~has[n])
        for m in subtypes:
            other = other | (own(n) & has[m] if m != n else F.lit(False))
    return _each_fault(j, ["entity_id"], {"missing": missing, "other": other})


def identifier_faults(identifiers: DataFrame, entities: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """namespace, value of identifiers (namespace, value, entity_id) whose owner isn't of the type that ``kinds`` has for the namespace."""
    want = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("namespace")]
    return identifiers.join(entities.select("entity_id", "entity_type"), "entity_id").where(F.col("entity_type") != want).select("namespace", "value")


def conflict_faults(conflicts: DataFrame, entities: DataFrame) -> DataFrame:
    """record_id, entity_type of conflicts (record_id, entity_type, strong_id, other_id) where either entity is of another type."""
    e = lambda n: entities.select(F.col("entity_id").alias(n), F.col("entity_type").alias(f"_{n}"))
    j = conflicts.join(e("strong_id"), "strong_id").join(e("other_id"), "other_id")
    return j.where((F.col("_strong_id") != F.col("entity_type")) | (F.col("_other_id") != F.col("entity_type"))).select("record_id", "entity_type")


def strong_identifier_faults(carried: DataFrame, identifiers: DataFrame, roots: DataFrame, conflicts: DataFrame) -> DataFrame:
    """record_id, namespace, fault of carried identifiers (record_id, entity_type, entity_id, namespace, value).

    unknown: nobody owns it; elsewhere: its owner (identifiers: namespace, value, owner) and the record's entity stay
    different entities through all merges (roots: node, root), and no conflict (record_id, entity_type, strong_id, other_id)
    names the two.
    """
    r = lambda c: roots.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"{c}_root"))
    j = carried.join(identifiers, ["namespace", "value"], "left")
    for c in ("entity_id", "owner"):
        j = j.join(r(c), F.col(c) == F.col(f"_{c}"), "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c)).drop(f"_{c}")
    named = conflicts.select("record_id", "entity_type", F.explode(F.array(F.struct(F.col("strong_id").alias("entity_id"), F.col("other_id").alias("owner")), F.struct(F.col("other_id").alias("entity_id"), F.col("strong_id").alias("owner")))).alias("p"))
    named = named.select("record_id", "entity_type", "p.*", F.lit(True).alias("_named")).distinct()
    j = j.join(named, ["record_id", "entity_type", "entity_id", "owner"], "left")
    return _each_fault(j, ["record_id", "namespace"], {"unknown": F.col("owner").isNull(), "elsewhere": (F.col("entity_id_root") != F.col("owner_root")) & F.col("_named").isNull()})


def newest_manual(manual: DataFrame) -> DataFrame:
    """The last imported manual decision (decision_id, play_id, scrobble_id, imported_ms, ...) of each pair; of those of one import the one with the greatest number."""
    w = Window.partitionBy("play_id", "scrobble_id").orderBy(F.desc("imported_ms"), F.desc("number"))
    return manual.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_link(links: DataFrame) -> DataFrame:
    """Of the links (play_id, scrobble_id, record_id, event_id) of each pair the one of the lowest record."""
    return links.groupBy("play_id", "scrobble_id").agg(F.min(F.struct("record_id", "event_id")).alias("l")).select("play_id", "scrobble_id", "l.*")


def manual_faults(manual: DataFrame, artifacts: DataFrame, states: DataFrame, events: DataFrame, links: DataFrame) -> DataFrame:
    """decision_id, fault of manual decisions (decision_id, play_id, scrobble_id, decision, source_event, target_event, imported_ms, number).

    type: the artifact (decision_id, decision_type) says otherwise.  Of each pair's newest one: merged (a rejection that names
    events), state (the pair's state isn't manually_rejected or manually_accepted), lineage (the source event of an
    acceptance isn't superseded by its target), links (the target event hasn't both records, the scrobble as a
    cross_source_match).
    """
    last = newest_manual(manual).select(F.col("decision_id").alias("_last")).distinct()
    j = manual.join(_first(artifacts, "decision_id", _type="decision_type"), F.col("decision_id") == F.col("_decision_id"), "left").join(last, F.col("decision_id") == F.col("_last"), "left")
    j = j.join(states.select("play_id", "scrobble_id", F.col("state").alias("_state")), ["play_id", "scrobble_id"], "left")
    j = j.join(_first(events, "event_id", _status="event_status", _by="superseded_by"), F.col("source_event") == F.col("_event_id"), "left")
    l = links.select("event_id", "record_id", "role").distinct()
    has = lambda c, ok: l.where(ok).select(F.col("event_id").alias("target_event"), F.col("record_id").alias(c), F.lit(True).alias(f"_{c}")).distinct()
    j = j.join(has("play_id", F.lit(True)), ["target_event", "play_id"], "left").join(has("scrobble_id", F.col("role") == "cross_source_match"), ["target_event", "scrobble_id"], "left")
    newest, no, yes = F.col("_last").isNotNull(), F.col("decision") == "reject", F.col("decision") == "accept"
    state = F.when(no, F.lit("manually_rejected")).when(yes, F.lit("manually_accepted"))
    return _each_fault(j, ["decision_id"], {
        "type": F.col("_type") != F.col("decision"), "merged": newest & no & (F.col("source_event").isNotNull() | F.col("target_event").isNotNull()), "state": newest & ~F.col("_state").eqNullSafe(state),
        "lineage": newest & yes & ~F.coalesce((F.col("_status") == "superseded") & (F.col("_by") == F.col("target_event")), F.lit(False)), "links": newest & yes & (F.col("_play_id").isNull() | F.col("_scrobble_id").isNull()),
    })


def identity_decision_faults(decisions: DataFrame, entities: DataFrame, artifacts: DataFrame) -> DataFrame:
    """decision_id, fault of identity decisions (decision_id, type, subject, object, supersedes).

    types: a merge or split of entities (entity_id, entity_type) of different types, or without object; supersedes: what is
    superseded isn't a merge of the same two by a split; artifact: its artifact (decision_id, decision_type) says otherwise.
    """
    e = lambda n: entities.select(F.col("entity_id").alias(n), F.col("entity_type").alias(f"_{n}"))
    old = decisions.select(F.col("decision_id").alias("supersedes"), F.col("type").alias("_old"), F.col("subject").alias("_old_s"), F.col("object").alias("_old_o"))
    j = decisions.join(e("subject"), "subject", "left").join(e("object"), "object", "left").join(old, "supersedes", "left").join(_first(artifacts, "decision_id", _said="decision_type"), F.col("decision_id") == F.col("_decision_id"), "left")
    undone = (F.col("type") == "split") & (F.col("_old") == "merge") & (F.col("subject") == F.col("_old_s")) & (F.col("object") == F.col("_old_o"))
    return _each_fault(j, ["decision_id"], {
        "types": F.col("type").isin("merge", "split") & (F.col("_object").isNull() | (F.col("_subject") != F.col("_object"))), "supersedes": F.col("supersedes").isNotNull() & ~F.coalesce(undone, F.lit(False)), "artifact": F.col("_said") != F.col("type"),
    })


def ordinal_faults(accepted: DataFrame, rejected: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, fault of the ordinals of accepted and rejected records together (file_id, ordinal, source), for files (file_id, source, total).

    value: null or negative; conflict: one ordinal twice; kind: a record of another source than the file; range: not below
    total; gap: fewer different ordinals than total.
    """
    both = accepted.select("file_id", "ordinal", "source").unionByName(rejected.select("file_id", "ordinal", "source"))
    own = _first(files, "file_id", _source="source", _total="total")
    good = F.when(F.col("ordinal") >= 0, F.col("ordinal"))
    j = both.join(own, F.col("file_id") == F.col("_file_id"))
    # counted per ordinal first: a file may hold most records
    each = j.groupBy("file_id", "_total", good.alias("o")).agg(F.count("*").alias("n"), F.count_if(F.col("source") != F.col("_source")).alias("strange"))
    g = each.groupBy("file_id").agg(
        F.max(F.col("o").isNull()).alias("value"), F.max(F.col("o").isNotNull() & (F.col("n") > 1)).alias("conflict"), F.max(F.col("strange") > 0).alias("kind"), F.max(F.col("o") >= F.col("_total")).alias("range"),
        F.count_if(F.col("o") < F.col("_total")).alias("there"), F.max("_total").alias("_total"),
    )
    return _each_fault(g, ["file_id"], {"value": F.col("value"), "conflict": F.col("conflict"), "kind": F.col("kind"), "range": F.col("range"), "gap": F.col("there") < F.col("_total")})


def payload_faults(occurrences: DataFrame, payloads: DataFrame) -> DataFrame:
    """payload_id, fault: missing (occurrences of no payload), unused (a payload that nothing occurs of)."""
    o = occurrences.select("payload_id").distinct().withColumn("_used", F.lit(True))
    p = payloads.select("payload_id").distinct().withColumn("_there", F.lit(True))
    return _each_fault(o.join(p, "payload_id", "full"), ["payload_id"], {"missing": F.col("_there").isNull(), "unused": F.col("_used").isNull()})


def shape_faults(plays: DataFrame) -> DataFrame:
    """record_id, fault of accepted plays: duration (null or negative), start (before 1970), text (blank artist or track), uri (none)."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    return _each_fault(plays, ["record_id"], {
        "duration": ~ok(F.col("ms_played") >= 0), "start": ~ok(F.col("stopped_at_ms") - F.col("ms_played") >= 0), "text": blank(F.col("artist")) | blank(F.col("track")), "uri": blank(F.col("track_uri")),
    })


def unmerged_accepts(decided: DataFrame, links: DataFrame) -> DataFrame:
    """play_id, scrobble_id of accepted pairs that are not both linked to one event, the scrobble as a cross_source_match."""
    p = links.select(F.col("record_id").alias("play_id"), F.col("event_id").alias("_a"))
    s = links.where("role = 'cross_source_match'").select(F.col("record_id").alias("scrobble_id"), F.col("event_id").alias("_b"))
    j = decided.where("decision = 'accept'").join(p, "play_id", "left").join(s, "scrobble_id", "left")
    return j.where(~F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).select("play_id", "scrobble_id").distinct()
