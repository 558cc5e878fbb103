"""DataFrame operators: joins, mosaics, resampling, estimates, job and package analytics."""
