"""Column expressions shared by the jobs. All are built-in Spark functions, so
they stay inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference's behaviour for equal results.
#
# Liveness: the output of one ping counts as "up" when it matches this
# pattern, case-insensitively and anywhere in the text (Windows reply format).
PROBE_UP_PATTERN = r".*? \d+\.\d+\.\d+\.\d+.*=\d+.*?\d+ms TTL=\d+"
# Check-in, line 2 of the listener log: the caller's address is group 1
# (case-insensitive).
CONNECT_LINE_PATTERN = r"connect to \[.*?\] from \(\w+\) \[(.*?)\] \d+$"
# Check-in, line 3: the request; the MAC is group 1 (case-sensitive).
REQUEST_LINE_PATTERN = r"GET /\?MAC=(.*?) HTTP/1\.1"
# Report line words: state is "on " or "off", role is "master" or "slave ".
STATE_ON, STATE_OFF = "on ", "off"
ROLE_MASTER, ROLE_SLAVE = "master", "slave "
# Peer listings: "<ip>-node<i>" joined by "," and "<ip> node<i>" joined by
# a newline.
DNS_ENTRY_INFIX, DNS_SEPARATOR = "-node", ","
HOSTS_ENTRY_INFIX, HOSTS_SEPARATOR = " node", "\n"
# ---------------------------------------------------------------------------

# The same three patterns as one-pass chains: each group is atomic and takes the
# earliest place, so a text is read once whatever it holds. A match of the fixed
# pattern exists if and only if one exists with every part at its earliest place,
# as what follows a part may lie anywhere after it on the line.
PROBE_UP_CHAIN = r"(?m)^(?>.*? \d++\.\d++\.\d++\.\d)(?>.*?=\d)(?>.*?\dms TTL=\d)"
REQUEST_LINE_CHAIN = r"(?m)^(?>.*?GET /\?MAC=)(.*?) HTTP/1\.1"
# This one holds for the last line alone, where the fixed pattern must end.
CONNECT_LINE_CHAIN = r"\A(?>.*?connect to \[)(?>.*?\] from \(\w++\) \[)(.*)\] \d++\z"
# What "." does not match and "$" may stand before.
LINE_ENDS = "\n\r\u0085\u2028\u2029"

# Our labels for how a node is powered on, in order of priority: wake-on-LAN,
# a remote control host, a local hypervisor.
POWER_WOL, POWER_REMOTE, POWER_LOCAL = "wol", "remote", "local"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(c: str | Column) -> Column:
    """Truthiness of a boolean flag: null (absent) and false are not set.
    For a text field use ``is_set`` (null and '' are not set)."""
    c = _col(c)
    return F.coalesce(c.cast("boolean"), F.lit(False))


def is_set(c: str | Column) -> Column:
    """A text field that is present and not empty."""
    return F.coalesce(F.length(_col(c)) > 0, F.lit(False))


def mac_key(c: str | Column) -> Column:
    """Join key of the inventory: the MAC, upper-cased (null stays null)."""
    return F.upper(_col(c))


def probe_up(output: str | Column) -> Column:
    """True when a ping output shows a reply; null output is down."""
    return F.coalesce(_col(output).rlike("(?i)" + PROBE_UP_CHAIN), F.lit(False))


def _extract_or_null(c: Column, pattern: str) -> Column:
    # regexp_extract gives '' when nothing matches; a missing field is null.
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def _last_line(c: Column) -> Column:
    """The last line, without the line end that may close it."""
    closed = F.regexp_replace(c, r"(?:\r\n|[" + LINE_ENDS + r"])\z", "")
    return F.substring_index(F.translate(closed, LINE_ENDS, "\n" * len(LINE_ENDS)), "\n", -1)


def checkin_ip(connect_line: str | Column) -> Column:
    return _extract_or_null(_last_line(_col(connect_line)), "(?i)" + CONNECT_LINE_CHAIN)


def checkin_mac(request_line: str | Column) -> Column:
    return _extract_or_null(_col(request_line), REQUEST_LINE_CHAIN)


def power_source(is_physical: str | Column, nc: str | Column,
                 path: str | Column) -> Column:
    """How a node is powered on: wake-on-LAN, a remote host, a local
    hypervisor, or null when nothing is configured."""
    return (F.when(truthy(is_physical), F.lit(POWER_WOL))
            .when(is_set(nc), F.lit(POWER_REMOTE))
            .when(is_set(path), F.lit(POWER_LOCAL)))


def role(is_master: str | Column) -> Column:
    return F.when(truthy(is_master), F.lit("master")).otherwise(F.lit("slave"))


def state_line(up: str | Column, is_master: str | Column, idx: str | Column,
               n: str | Column, mac: str | Column, ip: str | Column) -> Column:
    """One report line: state, role, index, cluster size, MAC, address."""
    state = F.when(F.coalesce(_col(up), F.lit(False)), F.lit(STATE_ON)).otherwise(F.lit(STATE_OFF))
    rolew = F.when(truthy(is_master), F.lit(ROLE_MASTER)).otherwise(F.lit(ROLE_SLAVE))
    text = lambda c: F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.concat_ws(" ", state, rolew, text(idx), text(n), text(mac), text(ip))


def dns_entry(ip: str | Column, idx: str | Column) -> Column:
    return F.concat(F.coalesce(_col(ip), F.lit("")), F.lit(DNS_ENTRY_INFIX), _col(idx).cast("string"))


def hosts_entry(ip: str | Column, idx: str | Column) -> Column:
    return F.concat(F.coalesce(_col(ip), F.lit("")), F.lit(HOSTS_ENTRY_INFIX), _col(idx).cast("string"))
