"""All registries of the core."""

from __future__ import annotations

from tidemill.plans import customers, events, gold, menus, relational, reports, skewed_keys, storage, streams, tidied

REGISTRIES = [m.REGISTRY for m in (skewed_keys, events, menus, customers, relational, gold, reports, streams, storage, tidied)]
