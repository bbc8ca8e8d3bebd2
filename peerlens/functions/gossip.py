"""Topics, message ids and slot timing."""

from pyspark.sql import functions as F

from peerlens import domains as D


def compose_topic(fork_digest, kind):
    digest = F.regexp_replace(fork_digest, "^0x", "")
    return F.concat(F.lit("/eth2/"), digest, F.lit("/"), kind, F.lit("/" + D.TOPIC_ENCODING))


def compose_attnets_topic(fork_digest, subnet):
    """Subnet topic; '' outside 1..64 (real subnets start at 0, the bound is kept as is)."""
    name = F.concat(F.lit(D.ATTESTATION_PREFIX), subnet.cast("string"))
    return F.when(subnet.between(1, D.SUBNET_LIMIT), compose_topic(fork_digest, name)).otherwise("")


def topic_pretty(topic):
    return F.try_element_at(F.split(topic, "/"), F.lit(4))


def topic_subnet(topic):
    """Subnet number, NULL where the topic has none."""
    return F.regexp_extract(topic, "attestation_([0-9]+)", 1).try_cast("int")


def slot_start_micros(slot, genesis):
    return (genesis + slot * F.lit(D.SECONDS_PER_SLOT)) * F.lit(1_000_000)


def time_in_slot(arrival, slot, genesis):
    """Seconds since the slot began; negative for early messages."""
    return (F.unix_micros(arrival) - slot_start_micros(slot, genesis)) / F.lit(1_000_000.0)


def message_id(payload):
    """URL-safe base64 of the SHA-256 of the payload."""
    return F.translate(F.base64(F.unhex(F.sha2(payload, 256))), "+/", "-_")
