"""Models, solvers and simulation."""
