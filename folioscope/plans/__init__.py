"""folioscope.plans"""
