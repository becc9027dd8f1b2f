"""The session comes from the tests above; the subpackage's tests need nothing else."""
