"""Estimators and encoders: a state fitted on the training rows of each fold, and expressions that apply it."""
