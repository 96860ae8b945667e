"""Readers and writers: indicator tables with sidecars, folds, traces, JSON records, manifests, checkpoints."""
