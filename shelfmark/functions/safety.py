"""What kind of file a path is, and what a cleanup may do with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import normalized

#: Fixed values: (class, risk, confidence, path parts, substrings, endings); the first that fits counts.
CLASSES = [
    ("System", "Critical", 99, [], ["\\windows\\system32\\", "\\windows\\winsxs\\", "\\windows\\servicing\\", "\\boot\\"], []),
    ("Project", "High", 92, [".git", ".svn", "src", "source"], [], ["cargo.toml", "package.json", "pyproject.toml"]),
    ("BuildArtifact", "Medium", 88, ["node_modules", "target", "__pycache__", ".gradle", "dist", "build", "obj", "bin"], [], []),
    ("Cache", "Low", 92, ["cache", "caches", "npm-cache", "code cache", "gpucache"], ["\\appdata\\local\\temp\\"], []),
    ("Temporary", "Low", 86, ["temp", "tmp"], [], [".tmp", ".temp"]),
    ("Log", "Low", 82, [], [], [".log", ".trace"]),
    ("UserData", "High", 85, ["documents", "desktop", "pictures", "videos", "music", "downloads"], [], []),
    ("Application", "High", 88, [], ["\\program files\\", "\\program files (x86)\\", "\\programdata\\"], []),
]
#: Paths that no cleanup touches.
PROTECTED_INSIDE = ["\\windows\\system32\\", "\\windows\\winsxs\\", "\\windows\\servicing\\", "\\system volume information\\", "\\program files\\windows defender\\"]
PROTECTED_ENDS = ["\\windows", "\\ntldr", "\\bootmgr"]


def any_of(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def normal_path(path: Column) -> Column:
    return F.replace(normalized(path), F.lit("/"), F.lit("\\"))


def classified(path: Column, flags: Column) -> Column:
    """struct(class, risk, confidence)."""
    return class_of(normal_path(path), flags)


def class_of(p: Column, flags: Column) -> Column:
    """``classified`` of a path in its normal form."""
    parts = F.split(p, r"\\")
    out = None
    for name, risk, confidence, components, inside, ends in CLASSES:
        tests = [F.contains(p, F.lit(x)) for x in inside] + [F.endswith(p, F.lit(x)) for x in ends]
        if components:
            tests.append(F.arrays_overlap(parts, F.array(*map(F.lit, components))))
        if name == "System":
            tests.append(flags.bitwiseAND(4) != 0)
        value = F.struct(F.lit(name).alias("class"), F.lit(risk).alias("risk"), F.lit(confidence).alias("confidence"))
        out = F.when(any_of(tests), value) if out is None else out.when(any_of(tests), value)
    return out.otherwise(F.struct(F.lit("Unknown").alias("class"), F.lit("High").alias("risk"), F.lit(25).alias("confidence")))


def protected(path: Column) -> Column:
    return guarded(normal_path(path))


def guarded(p: Column) -> Column:
    """``protected`` of a path in its normal form."""
    return any_of([F.contains(p, F.lit(x)) for x in PROTECTED_INSIDE] + [F.endswith(p, F.lit(x)) for x in PROTECTED_ENDS])


def cleanup_action(path: Column, kind: Column) -> Column:
    """struct(action, confidence) for a path of ``classified`` kind."""
    return action_of(protected(path), kind)


def action_of(is_protected: Column, kind: Column) -> Column:
    name, sure = kind["class"], kind["confidence"]
    value = lambda action, confidence: F.struct(F.lit(action).alias("action"), confidence.alias("confidence"))
    return (
        F.when(is_protected | (kind["risk"] == "Critical"), value("Deny", F.lit(100)))
        .when(name.isin("Cache", "Temporary"), value("Quarantine", sure))
        .when(name.isin("BuildArtifact", "Log"), value("RecommendOnly", sure))
        .when(name == "Unknown", value("Keep", F.lit(20)))
        .otherwise(value("Deny", sure))
    )


#: Defaults of the resource governor.
LIMITS = {"cpu_pause": 55, "memory_pause": 88, "cpu_throttle": 30, "active_ms": 1_500}


def governor(work: Column, cpu: Column, memory: Column, idle_ms: Column, battery: Column) -> Column:
    """Run, Throttle or Pause for a sample; queries in the foreground always run, updates of metadata ignore the user."""
    busy = F.when(cpu >= LIMITS["cpu_throttle"], "Throttle").otherwise("Run")
    return (
        F.when(work == "ForegroundQuery", "Run")
        .when((memory >= LIMITS["memory_pause"]) | (cpu >= LIMITS["cpu_pause"]), "Pause")
        .when(work == "MetadataUpdate", busy)
        .when((idle_ms < LIMITS["active_ms"]) | battery, "Pause")
        .otherwise(busy)
    )


def permitted(cost: Column, disk: Column, cpu: Column, memory: Column, idle_ms: Column, battery: Column) -> Column:
    """A query's permission by its cost; on a hard disk expensive ones wait for five seconds without input."""
    work = F.when(cost == "Moderate", "MetadataUpdate").otherwise("ContentParse")
    held = (cost == "Expensive") & (disk == "Hdd") & (idle_ms < 5_000)
    return F.when(cost == "Cheap", "Run").when(held, "Pause").otherwise(governor(work, cpu, memory, idle_ms, battery))
