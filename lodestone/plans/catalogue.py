"""All registries of the core."""

from . import building, core_problems, reference

FLAGSHIP = "q1_bm25"
REGISTRIES = [core_problems.REGISTRY, reference.REGISTRY, building.REGISTRY]
