"""Plans that put operators together: the learner and the driver's queries."""
