"""All driver queries; importing the query modules registers them."""

from voxfield.plans import queries_field, queries_frames, queries_metrics, queries_selection, queries_streams, queries_voxels  # noqa: F401
from voxfield.plans.registry import QUERIES, SQL  # noqa: F401
