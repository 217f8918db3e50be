"""martline.plans"""
