"""All queries of the library by name."""

from braidline.plans import artifacts, contexts, decisions, exchanges, extensions, protocols, replay, runs, states, statistics, stories, traces

_PARTS = (contexts, exchanges, stories, states, runs, protocols, decisions, replay, statistics, traces, extensions, artifacts)
QUERIES = {name: q for part in _PARTS for name, q in part.R.queries.items()}
ORACLES = {name: q for part in _PARTS for name, q in part.R.oracles.items()}
