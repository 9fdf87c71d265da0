"""Profiles: what is asked, how answers are weighted; their checks and their two identities."""

from __future__ import annotations

import hashlib
import json
import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.scoring import EVIDENCE_METHODS, SCORE_METHODS

_REQUIRED = {"profile_schema_version", "id", "version", "name", "instruction", "criteria", "evidence_aggregation", "score_aggregation"}
_OPTIONAL = {"description"}
_CRITERION = {"id", "name", "role", "instructions", "weight", "threshold"}


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no blanks; other letters than ASCII stay as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _number(x: object) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)


def problems(profile: dict) -> list[str]:
    """What is wrong with a profile; empty for a valid one."""
    out = [f"missing {k}" for k in sorted(_REQUIRED - profile.keys())] + [f"unexpected {k}" for k in sorted(profile.keys() - _REQUIRED - _OPTIONAL)]
    if out:
        return out
    if profile["profile_schema_version"] != 1:
        out.append("profile_schema_version must be 1")
    if not re.fullmatch(r"[a-z][a-z0-9_]*", str(profile["id"])):
        out.append("id must be snake case")
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", str(profile["version"])):
        out.append("version must be fit for a path")
    for k in ("name", "instruction"):
        if not isinstance(profile[k], str) or not profile[k].strip():
            out.append(f"{k} must be a text")
    if not isinstance(profile["criteria"], list) or not all(isinstance(c, dict) for c in profile["criteria"]) or not isinstance(profile["evidence_aggregation"], dict) or not isinstance(profile["score_aggregation"], dict):
        return [*out, "criteria must be a list of objects, the aggregations objects"]
    seen: set[str] = set()
    for c in profile["criteria"]:
        if more := sorted(c.keys() - _CRITERION):
            out.append(f"{c.get('id')}: unexpected {', '.join(more)}")
        name = c.get("id") if isinstance(c.get("id"), str) else ""
        if name in seen or not re.fullmatch(r"[a-z][a-z0-9_]*", name):
            out.append(f"criterion id {name!r} is no new snake-case name")
        seen.add(name)
        if not str(c.get("instructions", "")).strip():
            out.append(f"{name}: empty instructions")
        if c.get("role") == "core":
            if "threshold" in c or not _number(c.get("weight", 1.0)) or c.get("weight", 1.0) <= 0:
                out.append(f"{name}: a core criterion has a positive weight and no threshold")
        elif c.get("role") == "auxiliary":
            if "weight" in c or "threshold" in c and not (_number(c["threshold"]) and 0 <= c["threshold"] <= 1):
                out.append(f"{name}: an auxiliary criterion has no weight, and a threshold in [0, 1] if any")
        else:
            out.append(f"{name}: role must be core or auxiliary")
    if not any(c.get("role") == "core" for c in profile["criteria"]):
        out.append("no core criterion")
    evidence, score = profile["evidence_aggregation"], profile["score_aggregation"]
    weights = evidence.get("top_weights", [1.0])
    if evidence.get("method") not in EVIDENCE_METHODS or not weights or not all(_number(w) and w > 0 for w in weights):
        out.append("no such evidence aggregation")
    shares = [score.get("geometric_weight", 0.5), score.get("bottleneck_weight", 0.5)]
    if score.get("method") not in SCORE_METHODS or not all(_number(w) and w >= 0 for w in shares) or sum(shares) == 0:
        out.append("no such score aggregation")
    return out


def load(path: str) -> dict:
    profile = json.loads(Path(path).read_text(encoding="utf-8"))
    if found := problems(profile):
        raise ValueError("; ".join(found))
    return profile


def profile_hash(profile: dict) -> str:
    """The identity of the whole profile."""
    return hashlib.sha256(canonical_json(profile).encode()).hexdigest()


def question_hash(profile: dict) -> str:
    """The identity of what is asked alone: weights, roles and methods may change under it."""
    return hashlib.sha256(canonical_json({"instruction": profile["instruction"], "questions": questions(profile)}).encode()).hexdigest()


#: Fixed value: the type of an answer, which is part of the questions' hash.
ANSWER = "noul"


def questions(profile: dict) -> dict[str, dict[str, str]]:
    """What is asked: instructions and type by criterion."""
    return {c["id"]: {"instructions": c["instructions"], "type": ANSWER} for c in profile["criteria"]}


def criterion_ids(profile: dict, role: str | None = None) -> list[str]:
    """The criteria in declared order, of a role if one is named."""
    return [c["id"] for c in profile["criteria"] if role in (None, c["role"])]


def exported(profile: dict) -> list[tuple[str, str, bool]]:
    """(id, role, has a threshold) of the criteria in declared order."""
    return [(c["id"], c["role"], "threshold" in c) for c in profile["criteria"]]


def packaged(name: str = "example") -> dict:
    """A profile that comes with the package."""
    return load(str(Path(__file__).parent / "profiles" / f"{name}.json"))


def answers(raw: Column, profile: dict) -> Column:
    """probabilities map<string,double> from a raw answer {"answers": {id: {type: number}}}; an incomplete one is an error."""
    parsed = F.from_json(raw, f"answers map<string,struct<{ANSWER}:double>>")["answers"]
    ids = criterion_ids(profile)
    found = F.map_from_arrays(F.array(*map(F.lit, ids)), F.array(*[F.try_element_at(parsed, F.lit(i))[ANSWER] for i in ids]))
    missing = F.exists(F.map_values(found), lambda x: x.isNull())
    return F.when(raw.isNotNull() & missing, F.raise_error(F.lit("an answer is incomplete"))).otherwise(F.when(raw.isNotNull(), found))


def criteria_frame(spark: SparkSession, profile: dict) -> DataFrame:
    """(profile_id, ord, criterion_id, role, weight, threshold) in declared order."""
    rows = [(profile["id"], k, c["id"], c["role"], float(c.get("weight", 1.0)) if c["role"] == "core" else None, float(c["threshold"]) if "threshold" in c else None) for k, c in enumerate(profile["criteria"])]
    return spark.createDataFrame(rows, "profile_id string, ord int, criterion_id string, role string, weight double, threshold double")
