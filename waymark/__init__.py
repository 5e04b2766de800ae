"""Analytics of marked-animal trajectories as Spark DataFrame operators."""
