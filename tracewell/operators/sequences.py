"""How far procedures came: lines against the steps that are expected, and markers of failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import timeline

#: Name, then layer and message of each step in order.
SEQUENCES = {
    "core setup": (
        ("SCTP-GW", r"Bind to .* was successful"),
        ("SCTP-GW", r"Successfully connected to"),
        ("SCTP-GW", r"SCTP connection to AMF established"),
        ("CU-CP", r"Connection to AMF on .* was established"),
        ("NGAP", r"Tx PDU.*NGSetupRequest"),
        ("NGAP", r"Rx PDU.*NGSetupResponse"),
        ("CU-CP", r"Connected to AMF"),
    ),
    "attach": (
        ("SCHED", r"prach\("),
        ("SCHED", r"RAR: ra-rnti="),
        ("SCHED", r"UL: ue=8192"),
        ("MAC", r"subPDUs: \[CCCH"),
        ("MAC", r'"MAC UE Creation": finished successfully'),
        ("MAC", r"CON_RES"),
        ("CU-CP-F1", r"Rx PDU.*InitialULRRCMessageTransfer"),
        ("CU-CP", r": UE created"),
        ("RRC", r"CCCH UL rrcSetupRequest"),
        ("RRC", r"CCCH DL rrcSetup\b"),
        ("RRC", r"DCCH UL rrcSetupComplete"),
        ("NGAP", r"Tx PDU.*InitialUEMessage"),
        ("NGAP", r"Rx PDU.*DownlinkNASTransport"),
        ("RRC", r"DCCH DL dlInformationTransfer|DCCH UL ulInformationTransfer"),
        ("NGAP", r"Rx PDU.*InitialContextSetupRequest"),
        ("CU-CP", r'"Initial Context Setup Routine" initialized'),
        ("SEC", r"K_gNB"),
        ("RRC", r"DCCH DL securityModeCommand"),
        ("CU-CP-F1", r"Tx PDU.*UEContextSetupRequest"),
        ("DU-F1", r"Rx PDU.*UEContextSetupRequest"),
        ("DU-F1", r"Tx PDU.*UEContextSetupResponse"),
        ("RRC", r"DCCH UL securityModeComplete"),
        ("RRC", r"DCCH DL ueCapabilityEnquiry"),
        ("RRC", r"DCCH UL ueCapabilityInformation"),
        ("CU-CP-E1", r"Tx PDU.*BearerContextSetupRequest"),
        ("CU-UP-E1", r"Tx PDU.*BearerContextSetupResponse"),
        ("CU-CP-E1", r"Tx PDU.*BearerContextModificationRequest"),
        ("RRC", r"DCCH DL rrcReconfiguration\b"),
        ("RRC", r"DCCH UL rrcReconfigurationComplete"),
        ("CU-CP", r'"Initial Context Setup Routine" finished successfully'),
        ("NGAP", r"Tx PDU.*InitialContextSetupResponse"),
    ),
    "session": (
        ("NGAP", r"Rx PDU.*InitialContextSetupRequest"),
        ("CU-CP-E1", r"Tx PDU.*BearerContextSetupRequest"),
        ("CU-UP-E1", r"Rx PDU.*BearerContextSetupRequest"),
        ("CU-UP", r"PDU session psi=\d+ attached"),
        ("CU-UP-E1", r"Tx PDU.*BearerContextSetupResponse"),
        ("CU-CP-E1", r"Rx PDU.*BearerContextSetupResponse"),
        ("CU-CP-F1", r"Tx PDU.*UEContextSetupRequest"),
        ("CU-CP-E1", r"Tx PDU.*BearerContextModificationRequest"),
        ("CU-UP-E1", r"Tx PDU.*BearerContextModificationResponse"),
        ("CU-UP", r"Attaching dl_teid="),
        ("RRC", r"DCCH DL rrcReconfiguration\b"),
        ("RRC", r"DCCH UL rrcReconfigurationComplete"),
        ("GTPU", r"Tunnel added"),
    ),
    "reestablishment": (
        ("SCHED", r"prach\("),
        ("MAC", r'"MAC UE Creation": finished successfully'),
        ("CU-CP-F1", r"Rx PDU.*InitialULRRCMessageTransfer"),
        ("RRC", r"CCCH UL rrcReestablishmentRequest"),
        ("RRC", r"CCCH DL rrcReestablishment\b"),
        ("RRC", r"DCCH UL rrcReestablishmentComplete"),
        ("RRC", r"DCCH DL rrcReconfiguration\b"),
        ("RRC", r"DCCH UL rrcReconfigurationComplete"),
    ),
    "release": (
        ("NGAP", r"Rx PDU.*UEContextReleaseCommand"),
        ("RRC", r"DCCH DL rrcRelease"),
        ("CU-CP-E1", r"Tx PDU.*BearerContextReleaseCommand"),
        ("CU-UP-E1", r"Rx PDU.*BearerContextReleaseCommand"),
        ("CU-UP", r"Disconnecting PDU session"),
        ("CU-UP-E1", r"Tx PDU.*BearerContextReleaseComplete"),
        ("CU-CP-E1", r"Rx PDU.*BearerContextReleaseComplete"),
        ("CU-CP-F1", r"Tx PDU.*UEContextReleaseCommand"),
        ("DU-F1", r"Rx PDU.*UEContextReleaseCommand"),
        ("DU-MNG", r": DRB traffic stopped"),
        ("DU-MNG", r'"UE Delete": Procedure started'),
        ("DU-MNG", r"SRB and DRB traffic stopped"),
        ("DU-F1", r"F1 UE context removed"),
        ("DU-MNG", r'"UE Delete": Procedure finished successfully'),
        ("DU-F1", r"Tx PDU.*UEContextReleaseComplete"),
        ("CU-CP-F1", r"Rx PDU.*UEContextReleaseComplete"),
        ("CU-CP", r'"UE Removal Routine" finished successfully'),
        ("NGAP", r"Tx PDU.*UEContextReleaseComplete"),
    ),
}
#: Name, layer, message and meaning of lines that tell of a failure.
MARKERS = (
    ("core setup", "SCTP-GW", r"SCTP connect to .* failed", "core network cannot be reached"),
    ("core setup", "NGAP", r"Rx PDU.*NGSetupFailure", "refused by the core network"),
    ("core setup", "CU-CP", r"Trying to reconnect to AMF", "association lost"),
    ("reestablishment", "RRC", r"CCCH DL rrcReject", "refused"),
    ("reestablishment", "RRC", r"CCCH DL rrcSetup\b", "full setup instead, context lost"),
    ("release", "DU-F1", r"RRC container not ACKed", "device did not answer"),
)


def reached(parsed: DataFrame, key: list[str], order: str, name: str | None = None, expected: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """For each key with a line of any step: steps reached in order, the last one, the first missing one, and all steps seen.

    parsed has layer and message.  Steps are numbered from 1 and given as numbers; a line may
    be several of them.  Missing is null where all were reached.
    """
    expected = expected or SEQUENCES[name]
    fits = [F.when((F.col("layer") == layer) & F.col("message").rlike(text), F.lit(k + 1)) for k, (layer, text) in enumerate(expected)]
    lines = parsed.where(F.col("layer").isin(*{layer for layer, _ in expected})).select(*key, order, F.explode(F.array_compact(F.array(*fits))).alias("step"))
    walked = timeline.steps(lines, key, "step", order, list(range(1, len(expected) + 1)))
    seen = lines.groupBy(*key).agg(F.array_sort(F.collect_set("step")).alias("seen"))
    return walked.join(seen, key) if key else walked.crossJoin(F.broadcast(seen))  # without a key both are one row


def markers(parsed: DataFrame, keep: list[str], known: tuple[tuple[str, str, str, str], ...] = MARKERS) -> DataFrame:
    """Lines that tell of a failure: which sequence's, and what it means."""
    fits = [F.when((F.col("layer") == layer) & F.col("message").rlike(text), F.struct(F.lit(name).alias("sequence"), F.lit(meaning).alias("meaning"))) for name, layer, text, meaning in known]
    return parsed.where(F.col("layer").isin(*{m[1] for m in known})).select(*keep, "layer", "message", F.inline(F.array_compact(F.array(*fits))))
