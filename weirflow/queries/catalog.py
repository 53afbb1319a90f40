"""All query modules of the core."""

from __future__ import annotations

from . import dealt, extras, flows, scalars, streaming, streams

MODULES = [streams, scalars, flows, extras, streaming, dealt]
flagship = streams.flagship
