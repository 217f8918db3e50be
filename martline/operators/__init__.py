"""martline.operators"""
