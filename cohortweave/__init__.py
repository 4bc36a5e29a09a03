"""DataFrame operators for hierarchical cohort data: patient, study, series, slice."""
