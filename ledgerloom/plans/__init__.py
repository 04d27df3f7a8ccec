"""Metadata-sized planning on the driver, and the migration job."""
