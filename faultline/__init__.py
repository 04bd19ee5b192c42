"""faultline: failure attribution over multi-agent trajectories, on Spark."""

__version__ = "0.1.0"
