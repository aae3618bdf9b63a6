"""Column functions on the texts of workflow tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Action names that write or read shared objects, argument names that are extracted.
ACTIONS = {
    "actions/cache": ("cacheWriteIntent", "cacheReadIntent"),
    "actions/cache/save": ("cacheWriteIntent",),
    "actions/cache/restore": ("cacheReadIntent",),
    "actions/upload-artifact": ("artifactWriteIntent",),
    "actions/download-artifact": ("artifactReadIntent",),
}
ARGUMENTS = (
    "ref", "repository", "path", "key", "restore-keys", "persist-credentials", "allow-unsafe-pr-checkout", "lookup-only", "name",
    "run-id", "github-token", "artifact-ids", "pattern", "merge-multiple", "if-no-files-found", "retention-days",
)
WORKFLOW_RUN_ID = "github.event.workflow_run.id"
#: Fixed values end.

_EDGE = r"(?U)^\s+|\s+$"


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends (trim() knows only U+0020)."""
    return F.regexp_replace(text, _EDGE, "")


def event_flag(detail: Column, flag: str) -> Column:
    """Whether a label is one of the ;-separated parts."""
    return F.array_contains(F.split(detail, ";"), flag)


def action_name(detail: Column) -> Column:
    """Before the last @; everything if there is none."""
    return F.when(F.instr(detail, "@") > 0, F.regexp_extract(detail, r"(?s)^(.*)@([^@]*)$", 1)).otherwise(detail)


def action_version(detail: Column) -> Column:
    """After the last @; empty if there is none."""
    return F.when(F.instr(detail, "@") > 0, F.regexp_extract(detail, r"(?s)^(.*)@([^@]*)$", 2)).otherwise(F.lit(""))


def normalized_expression(text: Column) -> Column:
    """The inside of a text that is one expression as a whole, otherwise the text, both stripped; null stays null."""
    bare = stripped(text)
    whole = r"(?Ud)^\$\{\{\s*(.*?)\s*\}\}\z"
    return F.when(bare.rlike(whole), stripped(F.regexp_extract(bare, whole, 1))).otherwise(bare)


def scope_access(detail: Column) -> tuple[Column, Column]:
    """Both sides of the first colon, stripped; nulls where there is no colon."""
    parts = F.split(detail, ":", 2)
    return stripped(F.get(parts, 0)), stripped(F.get(parts, 1))


def absent(marker: Column) -> Column:
    """null for the marker - that stands for not applicable."""
    return F.nullif(marker, F.lit("-"))


def or_absent(value: Column) -> Column:
    """The marker - where there is no value."""
    return F.coalesce(value, F.lit("-"))


def step_order(index: Column) -> Column:
    return index.cast("int")


def candidate_id(*parts: Column) -> Column:
    return F.concat(F.lit("artifact-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))
