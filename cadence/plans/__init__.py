"""Plan inspection, join-strategy selection and lineage helpers."""
