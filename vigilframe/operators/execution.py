"""Execution detectors: remote code in scripting applications, and new launch contexts that go out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SCRIPT_APPS, command_flags
from ..plans.policy import Policy
from .correlation import attribute_network, is_global
from .novelty import PATTERN, references

#: Places of users' files, and parents that seldom start programs.
USER_LOCATIONS = ("temporary", "downloads", "user-profile", "network-share")
UNUSUAL_PARENTS = ("winword.exe", "excel.exe", "outlook.exe", "powerpnt.exe", "chrome.exe", "msedge.exe", "firefox.exe")


def remote_execution(starts: DataFrame, policy: Policy) -> DataFrame:
    """Process starts (app, command, ...) of scripting applications that fetch and run; always of high priority. None if
    the policy leaves the detector off."""
    flags = command_flags(F.col("command"), F.col("app"))
    return starts.where(F.lit(policy.execution_enabled) & F.col("app").isin(*SCRIPT_APPS) & flags["remote_reference"] & flags["execution_primitive"]).withColumn("priority", F.lit("high"))


def outbound_from_new_context(starts: DataFrame, network: DataFrame, days: DataFrame, policy: Policy, peers: DataFrame | None = None) -> DataFrame:
    """Process starts (host, guid, created, day, app, parent, location, encoded) in a context new to a host with enough
    history, with outbound activity (host, guid, ts, destination, initiated) of the same process to a global address at or after them, from a user's place, an unusual
    parent or with an encoded argument. ``peers`` (host, app, parent, location, peer_eligible, peer_seen), of groups that may
    suppress, takes out what enough of the host's peers show too."""
    outbound = network.where(F.lit(policy.contextual_enabled) & F.col("initiated") & is_global(F.col("destination")))
    met = attribute_network(starts, outbound, ["host", "guid"]).drop("events")
    found = starts.join(met, ["host", "guid", "created"]).join(references(starts, days, policy), ["host", "day", *PATTERN])
    place = F.col("location").isin(*USER_LOCATIONS) | F.col("parent").isin(*UNUSUAL_PARENTS) | F.col("encoded")
    found = found.where(F.col("established") & F.col("local_new") & place)
    if peers is not None:
        common = peers.where((F.col("peer_eligible") >= policy.minimum_peer_hosts) & (F.col("peer_seen") / F.col("peer_eligible") >= policy.peer_common_fraction))
        found = found.join(common.select("host", *PATTERN), ["host", *PATTERN], "left_anti")
    return found.select("host", "guid", "created", "network_ts", *PATTERN)
