"""Validation of repository URLs and request parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts, names, and the number of segments of each browsing route.
HOSTS = ("github.com", "www.github.com")
OWNER = r"^[A-Za-z0-9][A-Za-z0-9-]{0,38}$"
REPO = r"^[A-Za-z0-9._-]{1,100}$"
ROUTES = {"tree": 4, "blob": 5, "commit": 4, "commits": 4, "releases": 3, "pull": 4, "issues": 3}
#: What a request may say.
LIMITS = {"limit": r"[0-9]{1,5}", "depth": r"[0-9]{1,2}"}
LENGTHS = {"q": 200, "job_id": 100, "node_id": 1000}


def parse_repo_url(url: Column, hosts: tuple[str, ...] = HOSTS) -> Column:
    """struct(owner, repo, clone_url, web_url, error) of a pasted URL; error is null when it names a repository.

    Checked in this order: empty, form, scheme, host, credentials, segments, route, owner, name.
    """
    raw = F.trim(url)
    full = F.when(raw.rlike(r"(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z]+)://", 1))
    authority = F.regexp_extract(full, r"^[A-Za-z]+://([^/?#\\]*)", 1)
    user = F.regexp_extract(authority, r"^(.*)@[^@]*$", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(authority, r"([^@]*)$", 1), r":[0-9]*$", ""))
    path = F.regexp_extract(full, r"^[A-Za-z]+://[^/?#\\]*([^?#]*)", 1)
    parts = F.filter(F.split(path, r"[/\\]", -1), lambda p: p != "")
    arity = F.coalesce(*[F.when(F.try_element_at(parts, F.lit(3)) == r, n) for r, n in ROUTES.items()], F.lit(0))
    owner, repo = F.try_element_at(parts, F.lit(1)), F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"(?i)\.git$", "")
    error = (
        F.when(url.isNull() | (raw == ""), "Repository URL is required")
        .when(full.rlike(r"\s") | (host == "") | ~host.rlike(r"^[A-Za-z0-9._~%-]+$"), "Repository URL is not a valid URL")
        .when(scheme != "https", "Repository URL must use https")
        .when(~host.isin(*hosts), "Only github.com repositories are supported")
        .when(~user.rlike(r"^:?$"), "Repository URL must not contain credentials")
        .when(F.size(parts) < 2, "Repository URL must include an owner and a repository name")
        .when((F.size(parts) > 2) & (arity != F.size(parts)), "Repository URL must point at the repository root")
        .when(~owner.rlike(OWNER), "Repository owner contains invalid characters")
        .when(~repo.rlike(REPO), "Repository name contains invalid characters")
    )
    good = error.isNull()
    web = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo)
    return F.struct(
        F.when(good, owner).alias("owner"), F.when(good, repo).alias("repo"), F.when(good, F.concat(web, F.lit(".git"))).alias("clone_url"), F.when(good, web).alias("web_url"), error.alias("error")
    )


def repo_id(owner: Column, repo: Column) -> Column:
    return F.lower(F.concat_ws("/", owner, repo))


def split_list(text: Column) -> Column:
    """Trimmed, non-empty items of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ",", -1), lambda x: F.trim(x)), lambda x: x != "")


def clone_error(message: Column) -> Column:
    """What to tell the user about a failed clone."""
    return (
        F.when(message.rlike(r"(?i)could not read Username|Authentication failed|terminal prompts disabled"), "private or needs authentication")
        .when(message.rlike(r"(?i)not found|does not exist|404"), "not found")
        .when(message.rlike(r"(?i)could not resolve host"), "network unreachable")
        .otherwise("clone failed")
    )


def check_params(**params: str | None) -> dict[str, str]:
    """The faults of request parameters by name."""
    faults = {}
    for name, value in params.items():
        if value is None:
            continue
        if name in LIMITS and not re.fullmatch(LIMITS[name], value):
            faults[name] = "must be a number"
        elif name in LENGTHS and not 0 < len(value) <= LENGTHS[name]:
            faults[name] = f"must have 1 to {LENGTHS[name]} characters"
    return faults


def within_root(root: str, path: str) -> bool:
    """Whether a path stays below a root."""
    import os.path

    base = os.path.abspath(root)
    full = os.path.abspath(os.path.join(base, path))
    return full == base or full.startswith(base + os.sep)
