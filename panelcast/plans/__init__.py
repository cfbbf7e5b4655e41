"""Model registry, planning, and the forecast pipeline."""
