"""All registries of the core, and the flagship query."""

from __future__ import annotations

from plumbline.plans import building, points, project, records, scenes

REGISTRIES = [records.R, points.R, project.R, scenes.R, building.R]


def flagship(spark, d):
    return points.voxel_filtered(spark, d)
