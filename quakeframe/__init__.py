"""Spark jobs for seismic picks, waveforms and corpus preparation."""
