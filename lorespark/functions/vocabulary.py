"""Closed vocabularies and limits of the store."""

from __future__ import annotations

# They must equal those the stored data was written with.
MEMORY_TYPES = ("user", "feedback", "project", "reference", "decision", "incident", "skill", "document", "note")
SOURCES = ("agent", "user", "system", "import", "sync")
ENTITY_TYPES = ("concept", "date", "dashboard", "decision", "file", "incident", "issue_tracker", "location", "memory", "organization", "person", "project", "tool")
RELATIONS = ("applies_to", "uses", "depends_on", "causes", "fixes", "contradicts", "supports", "follows", "related", "mentions", "replaces", "tracked_in")
RELATION_ALIASES = {"adds": "causes", "creates": "causes", "implements": "supports", "blocks": "contradicts", "tested_by": "related", "part_of": "applies_to"}
ENTITY_TYPE_ALIASES = {
    "concept": ("platform", "language", "feature", "framework", "library", "technology", "software", "service", "product", "system", "api", "component", "module", "package", "dependency", "protocol", "standard", "format", "algorithm", "pattern", "method", "function", "class", "interface", "command", "flag", "option", "config", "setting", "version", "release", "model", "metric", "topic", "skill", "reference", "note", "feedback", "url", "link", "keyword", "tag", "category"),
    "file": ("document", "doc", "artifact", "directory", "folder", "path", "repository", "repo", "codebase", "script"),
    "person": ("user", "author", "developer", "maintainer", "contributor", "agent", "owner", "assignee"),
    "organization": ("company", "org", "vendor", "group", "team", "department", "institution"),
    "incident": ("bug", "error", "failure", "outage", "vulnerability", "cve", "regression", "defect"),
    "decision": ("adr", "choice", "policy", "ruling"),
    "date": ("time", "datetime", "timestamp", "day", "month", "year", "deadline", "milestone"),
    "location": ("city", "country", "region", "place", "address", "site"),
    "issue_tracker": ("ticket", "issue", "jira", "github_issue", "pr", "pull_request"),
    "dashboard": ("panel", "board", "view", "report", "chart"),
}
CHANGE_ACTIONS = {"create": "created", "edit": "edited", "update": "updated", "rename": "renamed", "restore": "restored", "merge": "merged", "forget": "forgotten"}
QUEUE_STATUSES = ("pending", "processing", "done", "failed", "skipped", "dead")
DESCRIPTION_MOST, BODY_BYTES_MOST, NAME_MOST, CHUNKS_MOST, K_MOST = 500, 512_000, 80, 512, 4096
CHUNK_TOKENS, CHUNK_OVERLAP_TOKENS, CHARS_PER_TOKEN, PARTITION_BYTES = 400, 50, 2, 81_920
PURGE_DAYS = 90
