"""Stage gates and run checks: rule tables over one row of evidence a run.

Both give rows that say what was judged, so that reports are plain joins and counts.
Evidence comes as one nullable struct a stage; a null field has the default that is
written beside its rule, a null struct is missing evidence and fails hard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("time", "depth", "pose", "dynamic", "runtime", "map", "semantic")

#: Limits of the stage gates (times in ms, lengths in m, angles in degrees).
LIMITS = {
    "stereo_delta_ms": 10.0, "pinhole_only": True, "depth_valid_ratio": 0.15, "depth_temporal": 0.70, "left_right_required": True, "left_right_consistency": 0.60,
    "left_right_coverage": 0.25, "translation_step": 0.50, "rotation_step": 20.0, "position_std": 0.50, "dynamic_contamination": 0.01, "dynamic_unknown": 0.60,
    "largest_component": 0.10, "components": 1000, "significant_area": 5.0e-3, "significant_components": 1000, "tiny_area_ratio": 0.05, "pending_ratio": 0.10,
    "drop_ratio": 0.10, "depth_gpu_bytes": 20_000_000_000, "depth_worker_bytes": 16_000_000_000, "depth_restarts": 2, "errors": 0,
}
#: p95 limits in ms of a stage's service, its queue and its way from end to end.
SERVICE_MS = {"pose": 30.0, "tracking": 50.0, "segmentation": 250.0, "depth": 250.0, "fusion": 250.0, "dynamic": 100.0, "semantic_frontend": 5000.0, "global": 250.0}
QUEUE_MS = {"pose": 30.0, "tracking": 50.0, "segmentation": 250.0, "depth": 250.0, "fusion": 250.0, "dynamic": 100.0, "semantic_frontend": 5000.0, "global": 1000.0}
END_TO_END_MS = {"global": 1000.0}

Verdict = tuple[Column, Column]  # (passed, code)


def _all(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _get(stage: str, field: str, default) -> Column:
    return F.coalesce(F.col(f"{stage}.{field}"), F.lit(default))


def gate_time(limit: dict) -> Verdict:
    """``time``: valid, monotonic, pose_exact_match, relative_time_consistent, stereo_delta_ms, projection."""
    ok = _all(
        _get("time", "valid", False), *[_get("time", c, True) for c in ("monotonic", "pose_exact_match", "relative_time_consistent")],
        _get("time", "stereo_delta_ms", 0.0) <= limit["stereo_delta_ms"], F.lit(not limit["pinhole_only"]) | (_get("time", "projection", "pinhole") == "pinhole"),
    )
    return ok, F.when(ok, "time.contract").otherwise("time.contract_violation")


def gate_depth(limit: dict) -> Verdict:
    """``depth``: valid_ratio, temporal_agreement, left_right_consistency, left_right_coverage, left_right_available."""
    both, cover = F.col("depth.left_right_consistency"), _get("depth", "left_right_coverage", 1.0)
    seen = F.coalesce("depth.left_right_available", both.isNotNull() & (cover > 0))
    agree = seen & (F.coalesce(both, F.lit(0.0)) >= limit["left_right_consistency"]) & (cover >= limit["left_right_coverage"])
    ok = (_get("depth", "valid_ratio", 0.0) >= limit["depth_valid_ratio"]) & (_get("depth", "temporal_agreement", 0.0) >= limit["depth_temporal"])
    ok = ok & (agree | F.lit(not limit["left_right_required"]))
    return ok, F.when(F.lit(limit["left_right_required"]) & ~seen, "depth.missing_lr_evidence").when(ok, "depth.quality").otherwise("depth.inconsistent")


def gate_pose(limit: dict) -> Verdict:
    """``pose``: translation_step, rotation_step, position_std, timestamps_monotonic; unknown steps are infinite."""
    far = float("inf")
    ok = _all(*[_get("pose", c, far) <= limit[c] for c in ("translation_step", "rotation_step", "position_std")], _get("pose", "timestamps_monotonic", True))
    return ok, F.when(ok, "pose.quality").otherwise("pose.jump_or_uncertainty")


def gate_dynamic(limit: dict) -> Verdict:
    """``dynamic``: contamination, unknown_ratio."""
    ok = (_get("dynamic", "contamination", 1.0) <= limit["dynamic_contamination"]) & (_get("dynamic", "unknown_ratio", 1.0) <= limit["dynamic_unknown"])
    return ok, F.when(ok, "dynamic.isolation").otherwise("dynamic.static_contamination")


def gate_runtime(limit: dict) -> Verdict:
    """``runtime``: stages (array of stage, service_p95, queue_p95, end_to_end_p95), processed, dropped, errors, and the depth worker's gpu_bytes, worker_bytes, restarts.

    Without one measured service time of a known stage the evidence is missing.
    """
    def over(limits: dict, field: str) -> Column:
        allowed = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
        return F.exists("runtime.stages", lambda s: F.coalesce(s[field] > F.try_element_at(allowed, s["stage"]), F.lit(False)))

    measured = F.exists("runtime.stages", lambda s: s["stage"].isin(*SERVICE_MS) & s["service_p95"].isNotNull())
    processed, dropped = _get("runtime", "processed", 0), _get("runtime", "dropped", 0)
    late = over(SERVICE_MS, "service_p95") | over(QUEUE_MS, "queue_p95") | over(END_TO_END_MS, "end_to_end_p95") | (dropped / F.greatest(processed + dropped, F.lit(1)) > limit["drop_ratio"])
    broken = _get("runtime", "errors", 0) > limit["errors"]
    heavy = (_get("runtime", "gpu_bytes", 0) > limit["depth_gpu_bytes"]) | (_get("runtime", "worker_bytes", 0) > limit["depth_worker_bytes"]) | (_get("runtime", "restarts", 0) > limit["depth_restarts"])
    known = F.coalesce(measured, F.lit(False))
    late = F.coalesce(late, F.lit(False))
    ok = known & ~late & ~broken & ~heavy
    code = F.when(~known, "runtime.missing_evidence").when(broken, "runtime.stage_error").when(late, "runtime.p95_exceeded").when(heavy, "runtime.resource_exceeded")
    return ok, F.coalesce(code, F.lit("runtime.latency"))


def gate_map(limit: dict) -> Verdict:
    """``map``: largest, components, and where all three are known significant_area, significant_components, tiny_area_ratio."""
    largest = _get("map", "largest", 0.0) >= limit["largest_component"]
    fine = F.col("map.significant_area").isNotNull() & F.col("map.significant_components").isNotNull() & F.col("map.tiny_area_ratio").isNotNull()
    same = ~fine | (F.abs(F.col("map.significant_area") - limit["significant_area"]) <= 1e-12)
    by_area = (F.col("map.significant_components") <= limit["significant_components"]) & (F.col("map.tiny_area_ratio") <= limit["tiny_area_ratio"])
    ok = same & largest & F.when(fine, by_area).otherwise(_get("map", "components", 1 << 31) <= limit["components"])
    return ok, F.when(~same, "map.metric_contract_mismatch").when(ok, "map.connectivity").otherwise("map.fragmented_mesh")


def gate_semantic(limit: dict) -> Verdict:
    """``semantic``: required, pending, applied, rejected, submitted, workers_ready, and of the scene graph graph_attached, graph_applied, graph_pending, graph_unmapped, graph_errors."""
    need = _get("semantic", "required", False)
    pending, applied, rejected = (_get("semantic", c, 0) for c in ("pending", "applied", "rejected"))
    submitted = F.coalesce("semantic.submitted", pending + applied + rejected)
    open_ = (_get("semantic", "graph_pending", 0) > 0) | (_get("semantic", "graph_unmapped", 0) > 0) | (_get("semantic", "graph_applied", 0) <= 0)
    code = (
        F.when(need & ~_get("semantic", "workers_ready", False), "semantic.worker_unavailable").when(need & (submitted <= 0), "semantic.no_requests")
        .when(pending / F.greatest(pending + applied + rejected, F.lit(1)) > limit["pending_ratio"], "semantic.pending_backlog")
        .when(need & (_get("semantic", "graph_errors", 0) > 0), "semantic.graph_error").when(need & ~_get("semantic", "graph_attached", False), "semantic.graph_not_attached")
        .when(need & open_, "semantic.graph_pending")
    )
    return code.isNull(), F.coalesce(code, F.lit("semantic.delivery"))


GATES = {"time": gate_time, "depth": gate_depth, "pose": gate_pose, "dynamic": gate_dynamic, "runtime": gate_runtime, "map": gate_map, "semantic": gate_semantic}


def stage_gates(evidence: DataFrame, required: tuple[str, ...] = STAGES, limits: dict | None = None) -> DataFrame:
    """``id, stage, code, status, hard`` for each required stage of each run."""
    if unknown := set(required) - set(STAGES):
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    limit = LIMITS | (limits or {})
    rows = []
    for stage in required:
        ok, code = GATES[stage](limit)
        there = F.col(stage).isNotNull()
        rows.append(F.struct(F.lit(stage).alias("stage"), F.when(there, code).otherwise(f"{stage}.missing_evidence").alias("code"), F.when(there & ok, "PASS").otherwise("FAIL").alias("status"), F.lit(True).alias("hard")))
    return evidence.select("id", F.explode(F.array(*rows)).alias("g")).select("id", "g.*")


def gate_summary(gated: DataFrame) -> DataFrame:
    """``id, passed, hard_failures, warnings, blocking``: a run passes if no hard gate fails."""
    bad = F.col("hard") & (F.col("status") == "FAIL")
    return gated.groupBy("id").agg((F.count_if(bad) == 0).alias("passed"), F.count_if(bad).alias("hard_failures"), F.count_if(F.col("status") == "WARN").alias("warnings"), F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("code")))), ",").alias("blocking"))


def run_rules(rate: float, gates_digest: str, semantic: bool = True, allow_dirty: bool = False) -> dict[str, Column]:
    """Named checks of a run record; a null is no evidence and fails, unless the rule asks for null."""
    c = F.col
    equal = lambda name, value: F.abs(c(name) - value) <= 1e-9
    rules = {
        "provenance.clean_head": c("clean") | F.lit(allow_dirty), "provenance.git_sha": F.length("git_sha") > 0,
        "configuration.rate": equal("rate_hz", rate), "configuration.replay_pacing_rate": equal("paced_rate_hz", rate), "configuration.stage_rate_multiplier": equal("rate_multiplier", 1.0),
        "configuration.throttled": ~c("no_throttle"), "configuration.no_source_bursts": ~c("allow_bursts"), "configuration.full_dataset": c("max_frames").isNull(),
        "configuration.no_fault_injection": c("fault_stage").isNull() & (F.coalesce("fault_delay_ms", F.lit(0.0)) == 0) & (F.coalesce("fault_every", F.lit(0)) == 0),
        "configuration.standard_quality_gates": c("gates_digest") == gates_digest,
        "run.complete": c("status") == "complete", "run.all_frames_completed": c("frames_completed") == c("frames_requested"), "run.full_dataset": c("frames_requested") == c("dataset_frames"),
        "run.all_frames_dispatched": c("frames_dispatched") == c("frames_requested"), "run.no_resume": c("frames_resumed_from") == 0, "run.zero_drops": F.coalesce("dropped_frames", F.lit(0)) == 0,
        "quality.all_hard_gates": c("gates_passed") & (c("hard_failures") == 0) & c("report_passed"),
        "runtime.zero_errors": c("errors") == 0, "runtime.zero_scheduler_drops": c("scheduler_drops") == 0,
        "runtime.real_segmentation": (c("segmentation_processed") > 0) & c("segmentation_p95").isNotNull(), "runtime.real_tracking": (c("tracking_processed") > 0) & c("tracking_p95").isNotNull(),
        "runtime.semantic_metric_consistency": (c("segmentation_processed") == c("segmentation_calls")) & (c("tracking_processed") == c("tracking_calls")),
        "runtime.full_rate_tracking": c("tracking_calls") == c("frames_requested"), "runtime.mapping_cycle_p95": c("cycle_p95_ms") <= 1000.0 / rate,
        "runtime.replay_pacing_evidence": ~c("allow_bursts") & c("times_preserved") & (c("sleep_s") + 1e-6 >= F.greatest(c("frames_requested") - 1, F.lit(0)) / rate) & (c("elapsed_s") + 1e-6 >= c("sleep_s")),
        "depth.resolved_profile": c("depth_iterations").isNotNull() & c("depth_precision").isNotNull() & (F.length("depth_digest") > 0) & F.when(c("depth_precomputed"), (c("depth_processed") > 0) & (c("depth_failed") == 0)).otherwise(c("depth_scale").isNotNull()),
    }
    if semantic:
        rules |= {
            "semantic.mode": c("semantic_mode") == "language", "semantic.real_corrections": (c("prompts") > 0) & (c("corrections") > 0),
            "semantic.graph_ack": c("graph_attached") & c("commit_valid") & (c("graph_applied") > 0) & (c("graph_pending") == 0) & (c("graph_unmapped") == 0) & (F.coalesce("graph_errors", F.lit(0)) == 0),
            "semantic.drain_complete": c("workers_ready") & (c("workers") > 0) & (c("workers_drained") == c("workers")) & ~c("timed_out"), "semantic.resolved_models": c("models_resolved") == c("models"),
        }
    return rules


def run_checks(runs: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``run, code, passed`` of every rule for every run."""
    each = F.array(*[F.struct(F.lit(k).alias("code"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in rules.items()])
    return runs.select("run", F.explode(each).alias("c")).select("run", "c.*")


def run_authority(checks: DataFrame, runs: DataFrame, semantic: bool = True, allow_dirty: bool = False) -> DataFrame:
    """``run, authoritative, failed, blocking``: an authoritative run passes every check, from a clean tree and with semantics."""
    bad = ~F.col("passed")
    a = checks.groupBy("run").agg(F.count_if(bad).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("code")))), ",").alias("blocking"))
    ok = (F.col("failed") == 0) & F.coalesce("clean", F.lit(False)) & F.lit(semantic and not allow_dirty)
    return a.join(runs.select("run", "clean"), "run").select("run", ok.alias("authoritative"), "failed", "blocking")


def compare_runs(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """``a, b, same_commit, same_dataset``: whether two runs may be compared at all."""
    side = lambda name: runs.select(F.col("run").alias(name), F.col("git_sha").alias(f"_{name}g"), F.col("dataset").alias(f"_{name}d"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    same = lambda x: F.coalesce(F.col(f"_a{x}") == F.col(f"_b{x}"), F.lit(False))
    return j.select("a", "b", same("g").alias("same_commit"), same("d").alias("same_dataset"))
